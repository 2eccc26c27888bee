"""Subject similarity expressions.

The reference compares subjects with a downloaded sentence-embedding model,
which cannot ship here. Three strategies are offered:

* ``tf_cosine`` (default, fully native): lower-case, split on anything that is
  not a letter or digit, drop the articles ``the``/``a``/``an``, and take the
  cosine of the term-count vectors.
* ``vectors``: join a ``(subject, vector)`` table and take the vector cosine.
* an encoder: a user-supplied Arrow UDF that embeds *distinct* subjects once,
  joined back by subject (the reference's memo cache becomes a dedup + join).

Every strategy returns 0 for an empty subject and clamps to [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: words dropped before the term-count cosine.
ARTICLES = ["the", "a", "an"]
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def subject_tokens(subject: Column) -> Column:
    """Term list of a subject: lower-case letter/digit runs, articles removed."""
    parts = F.split(F.lower(F.coalesce(subject, F.lit(""))), TOKEN_SPLIT)
    return F.filter(
        parts, lambda t: (t != F.lit("")) & ~F.array_contains(F.array(*[F.lit(a) for a in ARTICLES]), t)
    )


def _self_dot(toks: Column) -> Column:
    # sum over occurrences of count(token) == sum over distinct tokens of count^2
    return F.aggregate(toks, F.lit(0), lambda acc, t: acc + F.size(F.filter(toks, lambda u: u == t)))


def term_norm2(toks: Column) -> Column:
    """Squared norm of the term-count vector."""
    return _self_dot(toks)


def tf_cosine_from_tokens(a: Column, a_norm2: Column, b: Column, b_norm2: Column) -> Column:
    """Term-count cosine given token arrays and their squared norms."""
    dot = F.aggregate(a, F.lit(0), lambda acc, t: acc + F.size(F.filter(b, lambda u: u == t)))
    return F.when((a_norm2 == 0) | (b_norm2 == 0), F.lit(0.0)).otherwise(
        F.least(F.greatest(dot / (F.sqrt(a_norm2) * F.sqrt(b_norm2)), F.lit(0.0)), F.lit(1.0))
    )


def tf_cosine(a: Column, b: Column) -> Column:
    """Term-count cosine of two subject strings (0 if either is empty).

    The terms are bound once: as plain columns they would be split anew for
    each term that they are held against.
    """
    terms = F.struct(subject_tokens(a).alias("a"), subject_tokens(b).alias("b"))
    return F.get(F.transform(F.array(terms), lambda t: tf_cosine_from_tokens(t["a"], term_norm2(t["a"]), t["b"], term_norm2(t["b"]))), 0)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, 0 when either norm is 0, clamped to [0, 1].

    Spark 4.1 has no built-in vector cosine, so it is ``aggregate(zip_with)``;
    the arrays stay inside the row, no explode or shuffle.
    """
    return vector_cosine_from_norms(a, vector_norm(a), b, vector_norm(b))


def vector_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vector_cosine_from_norms(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """:func:`vector_cosine` given the vectors' norms."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        F.least(F.greatest(dot / (na * nb), F.lit(0.0)), F.lit(1.0))
    )


def hashing_encoder(dim: int = 64):
    """A deterministic stand-in encoder (feature hashing of subject terms).

    Shows the plug-in contract for real models: an iterator of pandas batches
    over *distinct* subjects, with the model loaded once in the iterator's
    prologue, returning ``(subject, vec)``. Runs on the executors via
    ``mapInPandas``; only distinct subjects are encoded.
    """
    import hashlib

    def encode(batches):
        import numpy as np
        import pandas as pd

        # a real encoder would load its weights here, once per task
        for pdf in batches:
            vecs = []
            for s in pdf["subject"].fillna(""):
                v = np.zeros(dim)
                for tok in s.lower().split():
                    h = int.from_bytes(hashlib.blake2b(tok.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
                vecs.append(v.tolist())
            yield pd.DataFrame({"subject": pdf["subject"], "vec": vecs})

    def run(subjects):
        from tracelens.session import ship_package

        ship_package(subjects.sparkSession)
        return subjects.mapInPandas(encode, "subject string, vec array<double>")

    return run
