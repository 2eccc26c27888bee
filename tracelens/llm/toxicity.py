"""Toxicity by weak supervision.

1. Lexicons. From a bounded sample of labelled documents, Spark counts in how
   many toxic and other documents each term occurs (words, and word beginnings
   of 4 to 7 letters with ``*``), and the terms with the largest log odds are
   kept. Together with a fixed list of insults they are the vocabulary.
2. Voters. The fixed list, several lexicons dealt from the learned words and
   word beginnings, and patterns of dense use each say yes or no on a document.
3. Label model. Spark counts all documents by their votes (at most 2 to the
   number of voters rows). Expectation maximisation fits a generative model of
   the hidden label: each voter's accuracy per class, and correlations as a
   tree in which a voter may depend on one other voter besides the label.
4. Classifier. A logistic regression on term densities is trained on the
   posterior labels of a bounded sample, and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, unit_hash

#: Insults that need no learning (fixed values).
INSULTS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile"]
WORD = re.compile(r"[^\W\d_]+")
SAMPLE_PER_CLASS, SAMPLE_CHARS, TERMS, MIN_DOCS = 1_500, 20_000, 400, 4
FIT_PER_CLASS = 3_000
STEMS = (4, 5, 6, 7)
#: How many times likelier a learned term is in toxic documents, at least.
LEAST_ODDS = 10


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def sampled(rows: DataFrame, by: Column, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by hash of the text; repeats of a text count once."""
    rows = rows.withColumn("class", by)
    counts = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("class") == value, per_class / n).otherwise(share)
    return rows.withColumn("u", unit_hash("text", seed=11)).where(F.col("u") < share).dropDuplicates(["class", "u"])


def learn_terms(labelled: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS, terms: int = TERMS) -> list[str]:
    """The ``terms`` terms with the largest smoothed log odds among labelled rows (text, toxic), best first.

    Toxic or other rows beyond about ``per_class``, and texts longer than
    ``max_chars``, are not learned from.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = sampled(rows.where(F.col("toxic").isin(0, 1) & F.length("text").between(1, max_chars)), F.col("toxic"), per_class)

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts, classes = batch.column(0).to_pylist(), batch.column(1)
            found = [sorted({x for w in set(WORD.findall(t.lower())) if len(w) > 2 for x in terms_of(w)}) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), classes], names=["terms", "toxic"])

    each = rows.select("text", "toxic").mapInArrow(distinct_terms, "terms array<string>, toxic int").select(F.explode("terms").alias("term"), "toxic")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    counts = each.groupBy("term").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).where(F.col("n1") >= MIN_DOCS)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    # odds weighted by how many toxic documents show the term
    best = counts.withColumn("odds", odds).where(F.col("odds") > math.log(LEAST_ODDS)).withColumn("weight", F.col("odds") * F.sqrt("n1"))
    return [r["term"] for r in best.orderBy(F.desc("weight"), "term").limit(terms).collect()]


class Vocabulary:
    """Counts of the terms of a text. Words seen are remembered, up to a bound."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = list(dict.fromkeys(INSULTS + terms))
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.of_word: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        words = WORD.findall(text.lower())
        known, out = self.of_word, np.zeros(len(self.terms), np.float32)
        if len(known) > 500_000:
            known.clear()
        for w in words:
            hits = known.get(w)
            if hits is None:
                hits = tuple(self.index[t] for t in terms_of(w) if t in self.index)
                if len(w) <= 48:
                    known[w] = hits
            for i in hits:
                out[i] += 1
        return out, len(words)


def voters(terms: list[str]) -> list[tuple[np.ndarray, float, float]]:
    """(terms, least occurrences, least share of the words) of each voter over ``Vocabulary(terms)``."""
    names = Vocabulary(terms).terms
    fixed = np.array([t in INSULTS for t in names])
    stem = np.array([t.endswith("*") for t in names])
    rank = np.cumsum(~fixed & ~stem)
    out = [(np.flatnonzero(fixed), 1, 0.0), (np.flatnonzero(fixed), 2, 0.01)]
    for k in range(3):
        out.append((np.flatnonzero(~fixed & ~stem & (rank % 3 == k)), 1, 0.0))
    out.append((np.flatnonzero(stem), 2, 0.01))
    out.append((np.flatnonzero(stem), 3, 0.03))
    out.append((np.arange(len(names)), 2, 0.02))
    return out


def votes_of(counts: np.ndarray, n_words: int, rules: list[tuple[np.ndarray, float, float]]) -> int:
    """The voters' answers as bits."""
    out = 0
    for k, (at, least, share) in enumerate(rules):
        hits = counts[at].sum()
        out |= int(hits >= least and hits >= share * n_words) << k
    return out


@dataclass
class LabelModel:
    """P(label) and P(vote | label, parent's vote) for a tree of voters."""

    prior: float
    parents: list[int]
    tables: np.ndarray  # voter, label, parent's vote -> probability of yes

    def posterior(self, votes: int) -> float:
        logs = np.log([1 - self.prior, self.prior])
        bits = [votes >> k & 1 for k in range(len(self.parents))]
        for k, p in enumerate(self.parents):
            yes = self.tables[k, :, bits[p] if p >= 0 else 0]
            logs = logs + np.log(yes if bits[k] else 1 - yes)
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))


def fit_label_model(patterns: dict[int, int], m: int, prior: float, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over counted vote patterns; ``prior`` is the share of label 1 until the correlations are found."""
    keys = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[k] for k in keys.tolist()], float)
    bits = (keys[:, None] >> np.arange(m) & 1).astype(float)
    post = np.clip(bits.mean(1) * 0.9 + 0.02, 0, 1) if len(keys) else np.zeros(0)
    parents, tables = [-1] * m, np.full((m, 2, 2), 0.5)
    model = LabelModel(prior, parents, tables)
    for step in range(rounds):
        weights = np.stack([n * (1 - post), n * post])
        if step in (rounds // 2, 3 * rounds // 4):  # accuracies have settled: find the strongest correlations within the classes
            parents = _tree(bits, weights)
        tables = np.empty((m, 2, 2))
        for k in range(m):
            for label in (0, 1):
                for v in (0, 1):
                    w = weights[label] * ((bits[:, parents[k]] == v) if parents[k] >= 0 else 1.0)
                    tables[k, label, v] = (w @ bits[:, k] + (0.05 if label == 0 else 0.5)) / (w.sum() + 1)
        share = float(np.clip((weights[1].sum() + prior) / (n.sum() + 1), 1e-4, 0.5))
        model = LabelModel(prior if step < rounds // 2 else share, parents, tables)
        post = np.array([model.posterior(int(k)) for k in keys.tolist()])
    return model


def _tree(bits: np.ndarray, weights: np.ndarray) -> list[int]:
    """Largest spanning tree of the voters' conditional mutual information given the label; the parent of each, -1 for roots."""
    m = bits.shape[1]
    total = weights.sum() or 1.0
    info = np.zeros((m, m))
    for w in weights:
        for a in range(m):
            for b in range(a):
                for x in (0, 1):
                    for y in (0, 1):
                        pa_, pb = w @ (bits[:, a] == x), w @ (bits[:, b] == y)
                        both = w @ ((bits[:, a] == x) & (bits[:, b] == y))
                        if both > 0:
                            info[a, b] += both / total * math.log(both * w.sum() / (pa_ * pb))
    info += info.T
    parents, inside = [-1] * m, [0]
    while len(inside) < m:
        gain, child, parent = max((info[c, p], -c, p) for c in range(m) if c not in inside for p in inside)
        parents[-child] = parent if gain > 1e-3 else -1
        inside.append(-child)
    return parents


def densities(counts: np.ndarray, n_words: int) -> np.ndarray:
    return np.log1p(100 * counts / max(1, n_words)).astype(np.float32)


@dataclass
class Model:
    terms: list[str]
    label_model: LabelModel
    weights: np.ndarray  # one per term, and the bias

    def score(self, counts: np.ndarray, n_words: int) -> float:
        z = float(densities(counts, n_words) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit(docs: DataFrame, labelled: DataFrame, fit_per_class: int = FIT_PER_CLASS) -> Model:
    """Learn terms from ``labelled`` (text, toxic), the label model and the classifier from the votes on ``docs`` (text).

    Labels choose the terms and start the label model's prior; the classifier
    sees posterior labels only. Without labels of both kinds the fixed insults
    alone vote.
    """
    spark = docs.sparkSession
    labels = {r["toxic"]: r["count"] for r in labelled.where("toxic IS NOT NULL").groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()}
    prior = min(0.5, max(0.005, (labels.get(1, 0) + 1) / (sum(labels.values()) + 20)))
    terms = learn_terms(labelled)
    rules = voters(terms)
    shared = spark.sparkContext.broadcast((terms, rules))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rules = shared.value
        vocabulary = Vocabulary(terms)
        for batch in slices(batches):
            out = [votes_of(*vocabulary.counts(t or ""), rules) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["text", "votes"])

    texts = docs.select(F.col("text").cast("string").alias("text"))

    def only_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in voted(batches):
            yield batch.select(["votes"])

    patterns = {r["votes"]: r["count"] for r in texts.mapInArrow(only_votes, "votes int").groupBy("votes").count().collect()}
    label_model = fit_label_model(patterns, len(rules), prior)
    likely = [v for v in patterns if label_model.posterior(v) >= 0.5]
    sizes = [sum(n for v, n in patterns.items() if (v in likely) == side) for side in (False, True)]
    names = Vocabulary(terms).terms
    if not all(sizes):
        weights = np.zeros(len(names) + 1)
        weights[: len(INSULTS)], weights[-1] = 3.0, -3.0
        return Model(terms, label_model, weights)

    # the sample is chosen by a hash of the text before its votes are known, and thinned by side afterwards
    share = [min(1.0, fit_per_class / n) for n in sizes]
    rows = texts.where(F.length("text").between(1, SAMPLE_CHARS)).withColumn("u", unit_hash("text", seed=13)).where(F.col("u") < max(share))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rules = shared.value
        vocabulary, wanted = Vocabulary(terms), set(likely)
        for batch in slices(batches):
            out = []
            for text, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts, n_words = vocabulary.counts(text)
                votes = votes_of(counts, n_words, rules)
                if u < share[votes in wanted]:
                    x = densities(counts, n_words)
                    at = np.flatnonzero(x)
                    out.append((u, votes, at.astype(np.int16), x[at]))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int16())), pa.array(cols[3], pa.list_(pa.float32()))], names=["u", "votes", "at", "x"])

    sample = rows.mapInArrow(featured, "u double, votes int, at array<short>, x array<float>").dropDuplicates(["u"]).orderBy("u").toArrow()
    x = np.zeros((sample.num_rows, len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, (at, v) in enumerate(zip(sample.column("at"), sample.column("x"), strict=True)):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    y = np.array([label_model.posterior(v) for v in sample.column("votes").to_pylist()], np.float32)
    return Model(terms, label_model, fit_logistic(x, y))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels with both classes of equal weight, by Nesterov's gradient method."""
    share = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    scale = float(np.linalg.norm(np.sqrt(share)[:, None] * x, 2) ** 2) if len(x) else 1.0
    step = 1 / (0.25 * scale + penalty)
    w = np.zeros(x.shape[1])
    v = w.copy()
    for k in range(rounds):
        grad = x.T @ (share * (1 / (1 + np.exp(-(x @ v))) - y)) + penalty * v
        new = v - step * grad
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``docs``; null and empty texts get the score of a text without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocabulary = Vocabulary(m.terms)
        for batch in slices(batches):
            out = [m.score(*vocabulary.counts(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double")
