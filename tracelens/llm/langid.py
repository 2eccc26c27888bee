"""Language identification in two levels: family first, then one-versus-one inside it.

A text's features are its hashed byte n-grams of two and three bytes (letters
in lower case, everything else one space), as square roots of counts with
length one. A linear support vector machine per family (one against the rest)
chooses the family; inside a family with several learned languages one linear
machine per pair of languages votes, and ties go to the larger sum of margins,
then to the first name.

The machines are fitted on the driver on a bounded sample: about
``per_language`` texts of each language, of at most ``max_chars`` characters,
picked by a hash of the row. Prediction reads every whole text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, unit_hash

#: Language families by ISO 639-1 code (fixed values); a language that is not
#: listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
UNKNOWN = "und"
DIMS = 4096
PER_LANGUAGE, MAX_CHARS = 1_000, 20_000
#: Least score of a text in a learned language: on held-out labels clean texts
#: scored 0.5 and more, other languages and letter junk below 0.4; a few that
#: mix learned languages score less (README).
LEAST_SCORE = 0.45
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, scaled to length one."""
    b = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    codes = np.concatenate([two, (two[:-1] << 8 | b[2:]) + np.uint32(1 << 24)])
    counts = np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(np.sqrt(x @ x), 1e-9)


def fit_machine(x: np.ndarray, positive: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> np.ndarray:
    """Linear machine with squared hinge loss, classes of equal weight, by Nesterov's gradient method; the last weight is the bias."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, step = w.copy(), 1 / (2 * 2 + penalty)  # rows have length one, and one for the bias
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = -2 * share * slack * y
        grad = np.append(x.T @ pull, pull.sum()) + penalty * v
        new = v - step * grad
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    families: dict[str, list[str]] = field(default_factory=dict)
    family_machines: dict[str, np.ndarray] = field(default_factory=dict)
    pair_machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a confidence in (0, 1); ``und`` and 0 for a text without a letter, or when nothing was learned."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        margin = {f: float(w[:-1] @ x + w[-1]) for f, w in self.family_machines.items()}
        family = min(self.families, key=lambda f: (-margin.get(f, 0.0), f))
        trust = _sigmoid(margin[family]) if margin else 1.0
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], trust
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), w in self.pair_machines.items():
            if a in sums and b in sums:
                m = float(w[:-1] @ x + w[-1])
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        best = min(langs, key=lambda c: (-votes[c], -sums[c], c))
        return best, trust * _sigmoid(sums[best] / (len(langs) - 1))


def _sigmoid(m: float) -> float:
    return float(1 / (1 + np.exp(-3 * m)))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model:
    """Learn from ``text`` and ``lang`` of ``docs``; rows with a null or letterless text, or a null lang, teach nothing.

    About ``per_language`` rows of each language are read to the driver as
    sparse features; exact repeats of a row count once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.length("text").between(1, max_chars))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([])
    share = spark.createDataFrame([(k, per_language / n) for k, n in counts.items()], "lang string, share double")
    picked = rows.withColumn("u", unit_hash("lang", "text")).join(F.broadcast(share), "lang").where("u < share").dropDuplicates(["lang", "u"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    out.append((lang, at.astype(np.int16), x[at]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.int16())), pa.array([r[2] for r in out], pa.list_(pa.float32()))], names=["lang", "at", "x"])

    sample = picked.select("lang", "text").mapInArrow(sparse, "lang string, at array<short>, x array<float>").toArrow()
    langs = np.array(sample.column("lang").to_pylist())
    x = np.zeros((len(langs), DIMS), np.float32)
    for i, (at, v) in enumerate(zip(sample.column("at"), sample.column("x"), strict=True)):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    order = np.lexsort((*x.T[:3], langs))  # rows arrive in any order
    langs, x = langs[order], x[order]
    model = Model(sorted(set(langs.tolist())))
    for lang in model.languages:
        model.families.setdefault(family_of(lang), []).append(lang)
    kin = np.array([family_of(c) for c in langs])
    if len(model.families) > 1:
        model.family_machines = {f: fit_machine(x, kin == f) for f in model.families}
    for members in model.families.values():
        for a, b in itertools.combinations(members, 2):
            own = (langs == a) | (langs == b)
            model.pair_machines[a, b] = fit_machine(x[own], langs[own] == a)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of columns of these names; one row per row.

    The text alone is read. Null texts, and such without a letter, are ``und``
    with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    at = rows.columns.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            found = [m.predict(t) for t in batch.column(at).to_pylist()]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, scores], names=[*batch.schema.names, "lang_pred", "score"])

    # no column is non-null by contract after a Python task
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(predicted, schema)


def tellable(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a letter and whose language is told with a score of at least ``least``.

    When no language was learned, every text with a letter stays. The best of
    two machines' sides scores 0.5 at least, so a model of one family, or of
    two with one language each, rejects no text with a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            keep = [bool(t and LETTER.search(t)) and (not m.languages or m.predict(t)[1] >= least) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
