"""Packing documents into fixed windows by minimum bin slack.

Every document is cut into whole windows and one remainder. Whole windows are
sequences by themselves. The remainders of a block of documents are packed
together: for each window, a subset-sum over the multiset of remaining lengths
(bits of one integer are the sums that can be reached; a length that occurs c
times is added in binary groups 1, 2, 4, ...) finds the fill closest to the
capacity, and walking back through the groups gives how often each length is
taken. When no subset fills a window exactly, a remainder is cut to close the
gap if that leaves less padding. What is left at a block's end fills one last
window, cut at powers of two: sequences of such a length need no padding.

A block is a run of consecutive documents of one input partition, bounded in
documents and tokens; so there is no shuffle, a task holds one block, and a
lost task repeats the same blocks from its input split.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

WINDOW = 2048
#: A block is closed at so many documents or so many ids of remainders.
BLOCK_DOCS, BLOCK_IDS = 4_096, 4_000_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(lengths: Counter, capacity: int) -> list[tuple[int, int]]:
    """(length, count) pairs taken from the multiset whose sum is the largest one up to ``capacity``.

    The largest length is always taken, so that hard ones go first.
    """
    usable = sorted((n for n, c in lengths.items() if c and n <= capacity), reverse=True)
    if not usable:
        return []
    taken = Counter({usable[0]: 1})
    room = capacity - usable[0]
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in usable:
        left = min(lengths[n] - taken[n], room // n)
        group = 1
        while left > 0 and not reach >> room & 1:
            k = min(group, left)
            steps.append((reach, n, k))
            reach |= reach << n * k & mask
            left, group = left - k, group * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for before, n, k in reversed(steps):
        if not before >> total & 1:
            taken[n] += k
            total -= n * k
    return list(taken.items())


def pack_block(remainders: list[tuple[int, int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), from remainders of that form with 0 < length < window."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for doc, start, n in remainders:
        by_length[n].append((doc, start))
    counts = Counter({n: len(v) for n, v in by_length.items()})
    left, out = sum(n * c for n, c in counts.items()), []

    def take(n: int) -> tuple[int, int, int]:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return *by_length[n].pop(), n

    def put(doc: int, start: int, n: int) -> None:
        by_length[n].append((doc, start))
        counts[n] += 1

    while left >= window:
        sequence = [take(n) for n, k in fill(counts, window) for _ in range(k)]
        gap = window - sum(p[2] for p in sequence)
        if gap:  # the rest is longer than the gap: cut its longest
            doc, start, n = take(max(counts))
            sequence.append((doc, start, gap))
            put(doc, start + gap, n - gap)
        out.append(sequence)
        left -= window
    rest = [take(n) for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    bit = window
    while left:
        while bit > left:
            bit //= 2
        sequence, room = [], bit
        while room:
            doc, start, n = rest.pop(0)
            if n > room:
                rest.insert(0, (doc, start + room, n - room))
                n = room
            sequence.append((doc, start, n))
            room -= n
        out.append(sequence)
        left -= bit
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``window`` is a power of two. Null texts count as empty, so each document
    has at least its end id. Null or repeated doc_ids are kept, each row as a
    document of its own. Other columns are left out. sequence_id holds the
    input partition in its upper bits, so that tasks need not agree.
    """
    if window & window - 1:
        raise ValueError("window must be a power of two")
    end = np.uint32(end_id).tobytes()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        sequence_id = TaskContext.get().partitionId() << 40
        block: list[tuple[int | None, int, int, bytes]] = []  # doc_id, ids in all, start of the remainder, its ids
        held, out = 0, []

        def rows(flush: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out
            while len(out) >= 2048 or flush and out:
                now, out = out[:2048], out[2048:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*now, strict=True), types, strict=True)], names=names)

        def packed() -> None:
            nonlocal sequence_id, held
            for sequence in pack_block([(k, 0, len(b[3]) // 4) for k, b in enumerate(block)], window):
                offset = 0
                for k, at, n in sequence:
                    doc_id, total, start, ids = block[k]
                    out.append((doc_id, start + at, n, ids[4 * at : 4 * (at + n)], total, sequence_id, offset))
                    offset += n
                sequence_id += 1
            block.clear()
            held = 0

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total // window * window
                for at in range(0, whole, window):
                    out.append((doc_id, at, window, ids[4 * at : 4 * (at + window)], total, sequence_id, 0))
                    sequence_id += 1
                if whole < total:
                    block.append((doc_id, total, whole, ids[4 * whole :]))
                    held += total - whole
                if len(block) >= block_docs or held >= BLOCK_IDS:
                    packed()
                yield from rows(False)
        packed()
        yield from rows(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECE_SCHEMA)


