"""Keyword-matching expressions over a lower-cased sentence.

Matching is raw substring containment (no word boundary), as the reference does:
``test`` hits ``latest`` and ``thus`` hits ``enthusiastic``. The lexicon is a
literal array, which Catalyst folds into one constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelens.functions import lexicon, scoring

CURLY_APOSTROPHES = "\u2018\u2019"


def lowered(sentence: Column, words: lexicon.Lexicon = lexicon.DEFAULT) -> Column:
    """The form of a text that phrases are looked for in."""
    return F.lower(F.translate(sentence, CURLY_APOSTROPHES, "''") if words.fold_apostrophes else sentence)


def with_lower(sentence: Column, fn, words: lexicon.Lexicon = lexicon.DEFAULT) -> Column:
    """Apply ``fn`` to ``lowered(sentence)`` computed once.

    Passing ``lower(s)`` straight into a keyword lambda re-lowers the sentence
    for every keyword once Catalyst inlines the projection; binding it as a
    lambda variable of a one-element ``transform`` evaluates it once.
    """
    return F.get(F.transform(F.array(lowered(sentence, words)), lambda low: fn(low)), 0)


def lit_array(values: Sequence[str]) -> Column:
    """A literal array, as one SQL expression (a column per phrase would be slow to build)."""
    if not values:
        return F.array().cast("array<string>")
    escaped = (v.replace("\\", "\\\\").replace("'", "\\'") for v in values)
    return F.expr("array(" + ", ".join(f"'{v}'" for v in escaped) + ")")


def keyword_hits(lower: Column, keywords: Sequence[str] | Column) -> Column:
    """Entries of ``keywords`` contained in ``lower``, in list order."""
    entries = keywords if isinstance(keywords, Column) else lit_array(keywords)
    return F.filter(entries, lambda k: F.contains(lower, k))


def keyword_any(lower: Column, keywords: Sequence[str]) -> Column:
    """True when any entry is contained (short-circuits)."""
    return F.exists(lit_array(keywords), lambda k: F.contains(lower, k))


def keyword_count(lower: Column, keywords: Sequence[str]) -> Column:
    """Number of list entries contained; duplicate entries count twice."""
    return F.size(keyword_hits(lower, keywords))


def first_keyword(lower: Column, keywords: Sequence[str]) -> Column:
    """First entry contained, in list order (not by text position); null if none."""
    return F.get(keyword_hits(lower, keywords), 0)


def verification_count(lower: Column) -> Column:
    return keyword_count(lower, lexicon.VERIFICATION_KEYWORDS)


def hedge_keyword(lower: Column) -> Column:
    return first_keyword(lower, lexicon.HEDGE_KEYWORDS)


def is_verification(lower: Column) -> Column:
    return keyword_any(lower, lexicon.VERIFICATION_KEYWORDS)


def finality_score(tail_lower: Column, words: lexicon.Lexicon = lexicon.DEFAULT) -> Column:
    """(certain − uncertain) / (certain + uncertain) phrase hits, 0 when none, 4 dp."""
    c = keyword_count(tail_lower, words.certain)
    u = keyword_count(tail_lower, words.uncertain)
    return F.when(c + u == 0, F.lit(0.0)).otherwise(scoring.round4((c - u) / (c + u)))
