"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a run of documents in a partition are laid out as
one chain of symbols. An index maps each adjacent pair that has a rank to all
its positions in the chain. Active ranks are applied in ascending order: all
positions of the pair are merged, and the lists of the pairs that arise beside
them are extended. So a rank is looked up once for all its places, and the
work grows with the number of merges. Words already encoded by the worker are
kept in a dictionary of bounded size.

The vocabulary file is one of the tokenizers library (normaliser NFC, white
space, lower case; words by pattern; byte letters; an end-of-word suffix). The
library itself is not used here; tests hold the result against it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import KEPT, KEPT_CHARS, byte_letters, gathered

ENCODED_SCHEMA = "doc_id long, ids array<int>, decoded string"
#: Characters that Arrow, but not the word pattern, takes for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class PairIndex:
    """A chain of symbols of many words, with the positions of each ranked pair."""

    def __init__(self, words: list[list[int]], merges: dict[int, tuple[int, int]]) -> None:
        self.merges, self.starts = merges, []
        self.symbols: list[int] = []
        self.after: list[int] = []
        self.before: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.active: list[tuple[int, int]] = []
        for word in words:
            start, n = len(self.symbols), len(word)
            self.starts.append(start if n else -1)
            self.symbols += word
            self.after += range(start + 1, start + n + 1)
            self.before += range(start - 1, start + n - 1)
            if n:
                self.after[-1] = self.before[start] = -1
            for k in range(n - 1):
                self._add(word[k] << 32 | word[k + 1], start + k)

    def _add(self, pair: int, position: int) -> int:
        """Note a position of a pair; its rank, or one beyond all for a pair that is never merged."""
        if pair not in self.merges:
            return 1 << 62
        rank = self.merges[pair][0]
        places = self.at.get(pair)
        if places is None:
            self.at[pair] = [position]
            heapq.heappush(self.active, (rank, pair))
        else:
            places.append(position)
        return rank

    def merge_all(self) -> None:
        symbols, after, before = self.symbols, self.after, self.before
        while self.active:
            rank, pair = heapq.heappop(self.active)
            left, right, new = pair >> 32, pair & 0xFFFFFFFF, self.merges[pair][1]
            places = sorted(self.at.pop(pair))
            for k, p in enumerate(places):
                q = after[p]
                if symbols[p] != left or q < 0 or symbols[q] != right:
                    continue  # used up by an earlier merge
                symbols[p], symbols[q] = new, -1
                r, lowest = after[q], rank
                after[p] = r
                if r >= 0:
                    before[r] = p
                    lowest = self._add(new << 32 | symbols[r], p)
                if before[p] >= 0:
                    lowest = min(lowest, self._add(symbols[before[p]] << 32 | new, before[p]))
                if lowest < rank:  # the word has a lower rank to apply first
                    if places[k + 1 :]:
                        self.at[pair] = places[k + 1 :] + self.at.pop(pair, [])
                        heapq.heappush(self.active, (rank, pair))
                    break

    def words(self) -> Iterator[list[int]]:
        for p in self.starts:
            out = []
            while p >= 0:
                out.append(self.symbols[p])
                p = self.after[p]
            yield out


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        joined = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(joined)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None:
            raise ValueError(f"{path}: not a vocabulary of the kind that this codec reads")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _symbols(self, word: str) -> list[int]:
        letters = list(word.encode().decode("latin-1").translate(self.letters))
        letters[-1] += self.suffix
        return [self.vocab[c] for c in letters if c in self.vocab]

    def _learn(self, words: set[str]) -> None:
        new = list(words)
        index = PairIndex([self._symbols(w) for w in new], self.merges)
        index.merge_all()
        for word, ids in zip(new, index.words(), strict=True):
            self.known[word] = array("I", ids).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of strings without white space."""
        if len(self.pieces) > KEPT or len(self.known) > KEPT:
            self.pieces.clear()
            self.known.clear()
        new = {p: self.pattern.findall(p) for p in pieces if p not in self.pieces}
        words = {w for found in new.values() for w in found if w not in self.known}
        self._learn(words)
        ids = {p: b"".join([self.known[w] for w in found]) for p, found in new.items()}
        found = [ids[p] if p in ids else self.pieces[p] for p in pieces]
        self.pieces.update((p, b) for p, b in ids.items() if len(p) <= KEPT_CHARS)
        for w in words:
            if len(w) > KEPT_CHARS:
                del self.known[w]
        return found

    @staticmethod
    def normalised(text: str) -> str:
        # lower case letter by letter: no special form of sigma at a word's end
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; none for null texts."""
        raw = texts.fill_null("").to_pylist()
        plain = [not any(s in t for s in (*self.special, *SEPARATORS)) for t in raw]
        rows = pa.array([self.normalised(t) if ok else "" for t, ok in zip(raw, plain, strict=True)], pa.string())
        out = gathered(pc.utf8_split_whitespace(rows), self._pieces)
        for i, ok in enumerate(plain):
            if not ok:
                parts = [p for p in self.split.split(raw[i]) if p]
                out[i] = b"".join([np.uint32(self.special[p]).tobytes() if p in self.special else b"".join(self._pieces(self.pattern.findall(self.normalised(p)))) for p in parts])
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does for a vocabulary without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every document; null texts count as empty and other columns are left out.

    Each row is encoded by itself: null or repeated doc_ids stay as they are.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, 512):
            ids = c.encode_all(batch.column(1))
            lengths = np.fromiter((len(b) // 4 for b in ids), np.int32, len(ids))
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat, pa.int32()))
            decoded = pa.array([c.decode(np.frombuffer(b, "<u4").tolist()) for b in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encoded, ENCODED_SCHEMA)
