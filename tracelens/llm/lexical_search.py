"""Ranked lexical search over bit-sliced Bloom signatures, with exact scores.

Index. A document's signature is a Bloom filter of its terms. Documents with
signatures of one length are put together in blocks, and a block is stored by
slices: for each bit of the signature a bitmap over the block's documents. A
term that stands in a document several times is entered once per level of
``LEVELS`` that its count reaches, so that slices also tell how often, at most.

Search. The slices of a term and level, and-ed, give the documents that may
hold it that often: none is missed, some are added by chance. Each level
stands for the highest count it may mean, hence for the most that the term can
add to the document's score; the sum over a query's terms is an upper bound of
the score. The documents with the highest bounds are scored exactly, and the
last of their scores is a threshold: a document whose bound lies below it is
provably not among the first. All others are scored exactly, from their texts.

Steps over the corpus, each a pass of its own without a shuffle of texts but
for the documents to be scored: document and term counts; the index (written);
bounds, twice, over the index; exact scores. Queries are taken in blocks of
bounded size, whose terms and weights are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_checked
from ..session import work_dir
from .common import slices, written

#: Documents that a query returns.
TOP = 20
#: Counts of a term that a signature tells apart (a level stands for counts below the next one).
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Slices of an entry; bits per entry; shortest and longest signature. Longer texts fill theirs, and are only scored more often.
HASHES, BITS, LEAST_BITS, MOST_BITS = 4, 10, 1 << 8, 1 << 20
#: Documents and bits of a block at most.
BLOCK_DOCS, BLOCK_BITS = 256, 1 << 23
#: Bytes of query text that are taken at a time, and of a row group of the index.
QUERY_BYTES, GROUP_BYTES = 4 << 20, 8 << 20
#: The score of a term: what its count approaches, and the weights of document length.
UNIT, COUNT_WEIGHT, LENGTH_WEIGHT = 1_000_000_000, 1000, 12
#: ASCII characters that are no letters and digits part terms; capitals become small (fixed values).
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX_SCHEMA = "bits int, doc_id array<long>, tk array<long>, n array<long>, slices binary"
BOUND_SCHEMA = "item int, doc_id long, tk long, bound long"
SCORE_SCHEMA = "item int, item_id long, doc_id long, tk long, score long"


def term_codes(texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct terms of some texts, and each text's terms as places among them."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = b"" if data is None else data[int(at[0]) : int(at[-1])].to_pybytes().translate(TERM_BYTES)
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
    coded = lists.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    parts = [codes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return coded.dictionary, [p[:0] if len(p) == 1 and empty[p[0]] else p for p in parts]


def term_hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))


def positions(hashes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each entry (term, level) in a signature of ``bits`` bits, a power of two: one row per entry."""
    h = (hashes + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def entries(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the term, level) for each level that each count reaches."""
    reached = np.searchsorted(LEVELS, counts, side="right")
    place = np.repeat(np.arange(len(counts)), reached)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(reached) - reached, reached)


def length_weight(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A document's length against the corpus' mean, in hundredths, a quarter of it counting."""
    return 75 + (25 * n * docs) // terms


def term_score(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * count) // (COUNT_WEIGHT * count + LENGTH_WEIGHT * m)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def packed(bits: int, marks: list[np.ndarray]) -> bytes:
    """Slices of a block: for each bit a bitmap over the documents, whose set bits ``marks`` lists."""
    table = np.zeros((bits, -(-len(marks) // 8) * 8), bool)
    for k, at in enumerate(marks):
        table[at, k] = True
    return np.packbits(table, axis=1).tobytes()


def build_index(rows: DataFrame) -> DataFrame:
    """Blocks of signatures of ``rows`` (doc_id, tk, text), written; texts without terms are left out."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = defaultdict(list)

        def block(bits: int) -> pa.RecordBatch:
            docs = waiting.pop(bits)
            columns = [pa.array([bits], pa.int32()), *[pa.array([[d[k] for d in docs]], pa.list_(pa.int64())) for k in range(3)], pa.array([packed(bits, [d[3] for d in docs])], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bits", "doc_id", "tk", "n", "slices"])

        for batch in slices(batches):
            terms, texts = term_codes(batch.column(2))
            hashes = term_hashes(terms)
            for doc_id, tk, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if not len(codes):
                    continue
                own, counts = np.unique(codes, return_counts=True)
                place, level = entries(counts)
                bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * len(place) - 1).bit_length()))
                marks = np.unique(positions(hashes[own[place]], level, bits)).astype(np.int32)
                waiting[bits].append((doc_id, tk, len(codes), marks))
                if len(waiting[bits]) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // bits)):
                    yield block(bits)
        for bits in sorted(waiting):
            yield block(bits)

    spark = rows.sparkSession
    path = work_dir(spark, "signatures")
    # short row groups, so that a reader holds few blocks at a time
    rows.select("doc_id", "tk", "text").mapInArrow(blocks, INDEX_SCHEMA).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


@dataclass
class Queries:
    """Some queries: ids, and their distinct terms' places in ``terms`` and repeats, one after the other (``starts``)."""

    ids: list
    terms: pa.Array
    place: np.ndarray
    repeats: np.ndarray
    starts: np.ndarray
    weights: np.ndarray | None = None
    docs: int = 0
    all_terms: int = 0


def read_queries(items: list) -> Queries:
    """Queries with at least one term, of (id, text) rows."""
    terms, texts = term_codes(pa.array([t for _, t in items], pa.string()))
    kept = [(i, Counter(codes.tolist())) for (i, _), codes in zip(items, texts, strict=True) if len(codes)]
    place = np.array([t for _, c in kept for t in c], np.int64)
    repeats = np.array([n for _, c in kept for n in c.values()], np.int64)
    starts = np.cumsum([0, *[len(c) for _, c in kept]])[:-1].astype(np.int64)
    return Queries([i for i, _ in kept], terms, place, repeats, starts)


def counted(rows: DataFrame, q: Queries) -> Queries:
    """``q`` with its terms' weights and the corpus' totals, counted over all of ``rows``."""
    terms = rows.sparkSession.sparkContext.broadcast(q.terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        df, docs, total = np.zeros(len(wanted), np.int64), 0, 0
        for batch in slices(batches):
            found, texts = term_codes(batch.column(0))
            at = pc.index_in(found, value_set=wanted).fill_null(-1).to_numpy()
            for codes in texts:
                docs, total = docs + (len(codes) > 0), total + len(codes)
                own = at[np.unique(codes)]
                df[own[own >= 0]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some], pa.int64()), pa.array([docs, total, *df[some]], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    q.docs, q.all_terms = sums.get(-1, 0), sums.get(-2, 0)
    q.weights = np.array([term_weight(q.docs, sums.get(k, 0)) for k in range(len(q.terms))], np.int64)
    return q


def block_bounds(bits: int, n: np.ndarray, cut: bytes, hashes: np.ndarray, q: Queries) -> np.ndarray:
    """Upper bounds of the scores of a block's documents: a row per query."""
    table = np.frombuffer(cut, np.uint8).reshape(bits, -1)
    level = np.zeros((len(hashes), len(n)), np.uint8)
    alive, before = np.arange(len(hashes)), None
    for k in range(len(LEVELS)):
        at = positions(hashes[alive], np.full(len(alive), k), bits)
        there = table[at[:, 0]]
        for j in range(1, HASHES):
            there &= table[at[:, j]]
        if before is not None:
            there &= before
        some = there.any(axis=1)
        alive, before = alive[some], there[some]
        if not len(alive):
            break
        level[alive] += np.unpackbits(before, axis=1, count=len(n))
    m = length_weight(n, q.docs, q.all_terms)
    most = [np.zeros_like(m), *[term_score(np.int64(high - 1), m) for high in LEVELS[1:]], np.full_like(m, UNIT // COUNT_WEIGHT)]
    adds = np.take_along_axis(np.array(most), level.astype(np.int64), axis=0) * q.weights[:, None]
    out = np.empty((len(q.starts), len(n)), np.int64)
    ends = [*q.starts[1:], len(q.place)]
    step = max(1, (1 << 22) // (len(n) * max(1, max(b - a for a, b in zip(q.starts, ends, strict=True)))))
    for i in range(0, len(q.starts), step):
        a, b = q.starts[i], ends[min(i + step, len(ends)) - 1]
        out[i : i + step] = np.add.reduceat(adds[q.place[a:b]] * q.repeats[a:b, None], q.starts[i : i + step] - a, axis=0)
    return out


def highest_bounds(index: DataFrame, q: Queries, top: int = TOP) -> DataFrame:
    """For each query the documents with the highest bounds above zero: item, doc_id, tk, bound."""
    shared = index.sparkSession.sparkContext.broadcast(q)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        hashes = term_hashes(q.terms)
        kept = np.zeros((len(q.starts), 0), np.int64)
        whose = np.zeros((len(q.starts), 0, 2), np.int64)  # doc_id (null: the least number) and text hash
        for batch in slices(batches, 16):
            for bits, ids, tks, n, cut in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.array([[-(2**63) if i is None else i, t] for i, t in zip(ids, tks, strict=True)], np.int64)
                bounds = np.concatenate([kept, block_bounds(bits, np.array(n, np.int64), cut, hashes, q)], axis=1)
                docs = np.concatenate([whose, np.broadcast_to(own, (len(q.starts), *own.shape))], axis=1)
                at = np.argpartition(-bounds, min(top, bounds.shape[1]) - 1, axis=1)[:, :top]
                kept, whose = np.take_along_axis(bounds, at, 1), np.take_along_axis(docs, at[:, :, None], 1)
        item, k = np.nonzero(kept > 0)
        ids, tks = whose[item, k, 0], whose[item, k, 1]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, mask=ids == -(2**63)), pa.array(tks), pa.array(kept[item, k])], names=["item", "doc_id", "tk", "bound"])

    order = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"), "tk")
    found = index.mapInArrow(best, BOUND_SCHEMA)
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def possible(index: DataFrame, q: Queries, thresholds: np.ndarray) -> DataFrame:
    """All documents whose bound reaches the query's threshold: item, doc_id, tk, bound."""
    shared = index.sparkSession.sparkContext.broadcast((q, np.maximum(1, thresholds)))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = shared.value
        hashes = term_hashes(q.terms)
        for batch in slices(batches, 16):
            for bits, ids, tks, n, cut in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                bounds = block_bounds(bits, np.array(n, np.int64), cut, hashes, q)
                item, k = np.nonzero(bounds >= least[:, None])
                k_of = pa.array(k)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()).take(k_of), pa.array(tks, pa.int64()).take(k_of), pa.array(bounds[item, k])], names=["item", "doc_id", "tk", "bound"])

    return index.mapInArrow(reach, BOUND_SCHEMA)


def exact_scores(rows: DataFrame, pairs: DataFrame, q: Queries, thresholds: np.ndarray | None = None) -> DataFrame:
    """The scores of (item, doc_id, tk) pairs that reach the query's threshold, from the documents' texts.

    Rows equal in doc_id and text are scored each.
    """
    least = np.ones(len(q.starts), np.int64) if thresholds is None else np.maximum(1, thresholds)
    shared = rows.sparkSession.sparkContext.broadcast((q, least))
    wanted = pairs.select("item", F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk")).groupBy("__doc", "__tk").agg(F.collect_set("item").alias("items"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("tk") == F.col("__tk"))
    chosen = join_checked(rows, written(wanted, "to-score"), same).select("doc_id", "tk", "text", "items")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = shared.value
        ends = [*q.starts[1:].tolist(), len(q.place)]
        starts = q.starts.tolist()
        for batch in slices(batches, 256):
            found, texts = term_codes(batch.column(2))
            at = pc.index_in(found, value_set=q.terms).fill_null(-1).to_numpy()
            items, score, row = [], [], []
            for k, (codes, its) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                own, counts = np.unique(codes, return_counts=True)
                place = at[own]
                m = length_weight(np.int64(len(codes)), q.docs, q.all_terms)
                adds = np.zeros(len(q.weights), np.int64)
                known = place >= 0
                adds[place[known]] = q.weights[place[known]] * term_score(counts[known].astype(np.int64), m)
                for i in its:
                    a, b = starts[i], ends[i]
                    s = int(adds[q.place[a:b]] @ q.repeats[a:b])
                    if s >= least[i]:
                        items.append(i)
                        score.append(s)
                        row.append(k)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array([q.ids[i] for i in items], pa.int64()), batch.column(0).take(row), batch.column(1).take(row), pa.array(score, pa.int64())],
                names=["item", "item_id", "doc_id", "tk", "score"],
            )

    return chosen.mapInArrow(scores, SCORE_SCHEMA)


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tk")
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Equal scores are ranked by doc_id, null ids last. Texts that are null or
    have no terms neither find nor are found. Rows with a repeated doc_id are
    documents of their own, rows with a repeated item_id queries of their own.
    Other columns are left out. About ``query_bytes`` of query texts are taken
    at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // query_bytes))
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "queries")
    index, results = None, []
    for part in range(parts):
        # a stated query set in blocks of bounded size
        q = read_queries([(r["item_id"], r["text"]) for r in asked.where(F.col("part") == part).collect()])
        if not q.ids or not counted(rows, q).docs:
            continue
        index = build_index(rows) if index is None else index
        first = exact_scores(rows, highest_bounds(index, q, top), q)
        last = {r["item"]: r["score"] for r in _ranked(first, top).where(F.col("rank") == top).select("item", "score").collect()}
        thresholds = np.array([last.get(i, 1) for i in range(len(q.ids))], np.int64)
        found = _ranked(exact_scores(rows, possible(index, q, thresholds), q, thresholds), top)
        results.append(written(found.select("item_id", "rank", "doc_id", "score"), "found"))
    return reduce(DataFrame.unionAll, results) if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
asked AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM benchmark),
wanted AS MATERIALIZED (SELECT i, item_id, unnest(terms) AS t FROM asked),
totals AS MATERIALIZED (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS terms FROM docs),
tf AS MATERIALIZED (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY r, t),
weights AS MATERIALIZED (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
adds AS MATERIALIZED (
  SELECT tf.r, tf.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.terms) * totals.docs) // totals.terms)))::BIGINT AS s
  FROM tf JOIN weights USING (t) JOIN docs d USING (r), totals),
scores AS (SELECT i, r, sum(s)::BIGINT AS score FROM wanted JOIN adds USING (t) GROUP BY i, r),
ranked AS (
  SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT asked.item_id, rank::INTEGER AS rank, docs.doc_id, score FROM ranked JOIN docs USING (r) JOIN asked USING (i) WHERE rank <= {TOP}
"""
