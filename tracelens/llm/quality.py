"""Quality rules and an importance score of every document.

Rules count words, symbols, repeated lines and repeated three-word windows.
The score is the log-likelihood ratio of a document's hashed n-grams between
two multinomials, one of trusted documents and one of the raw corpus, divided
by the number of n-grams. n-grams are runs of ``ORDER`` bytes of the text,
hashed to ``BUCKETS``; both multinomials are smoothed by ``SMOOTHING`` counts
per bucket. A document is kept when its score reaches a fixed threshold.

Raw counts cover every document and target counts every trusted one. Counts
are added up on the executors and the driver gets one number per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
ORDER, BUCKETS, SMOOTHING = 3, 1 << 14, 1.0
THRESHOLD = -0.5
#: Trusted ids that are sent to every executor; with more, texts are shuffled to them.
BROADCAST_IDS = 200_000
SCORED_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def n_grams(text: str) -> np.ndarray:
    """Buckets of the byte n-grams of a text; a text shorter than an n-gram has none."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < ORDER:
        return np.zeros(0, np.uint32)
    code = b[: len(b) - ORDER + 1].copy()
    for k in range(1, ORDER):
        code = code << np.uint32(8) | b[k : len(b) - ORDER + 1 + k]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


def rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = 0
    if n > 3:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        pairs = ids[:-1] * k + ids[1:]
        if k >= 2_000_000:  # three numbers no longer fit into 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= twice
        repeated = int(covered.sum())
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio of each bucket's share among trusted documents to its share in all ``docs``.

    ``trusted`` has one column, doc_id; all its ids count. With no trusted
    document all ratios are 0, which keeps every document.
    """
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").dropDuplicates()
    few = ids.count() <= BROADCAST_IDS
    ids = ids.withColumns({"trusted": F.lit(True), "part": F.lit(0)})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows without an id are dealt by their text, so that they are not one task
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.hash("text")).otherwise(0))
    rows = rows.join(F.broadcast(ids) if few else ids, ["doc_id", "part"], "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    counts = np.bincount(n_grams(text), minlength=BUCKETS)
                    raw += counts
                    if good:
                        target += counts
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(counted, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in sums.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == SMOOTHING * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Rule counts and score of each row; null and empty texts have no words and score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = [c.split()[0] for c in SCORED_SCHEMA.split(", ")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                grams = n_grams(text)
                out.append((*rules(text), float(ratios[grams].mean()) if len(grams) else 0.0))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.float64())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, SCORED_SCHEMA)


def verdicts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``scored`` with ``base_failed`` (too short or mostly repeated) and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
