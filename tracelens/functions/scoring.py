"""Scalar scoring expressions (proximity, match score, weights, label)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelens.functions import lexicon


def round4(x: Column) -> Column:
    """Python ``round(x, 4)``: half-even on the exact binary value.

    ``bround`` rounds the shortest decimal string instead and so differs from
    Python at about 0.2 % of ratios (0.71095 -> 0.711 versus 0.7109).
    ``format_number`` rounds the exact value, like Python, and stays JVM-side.
    """
    return F.regexp_replace(F.format_number(x, 4), ",", "").cast("double")


def proximity_score(gap: Column, decay: float = lexicon.PROXIMITY_DECAY) -> Column:
    """``exp(-gap / decay)``, gap in sentences."""
    return F.exp(-gap / F.lit(float(decay)))


def match_score(sim: Column, prox: Column, weights: tuple[float, float] = lexicon.MATCH_WEIGHTS) -> Column:
    return F.lit(float(weights[0])) * sim + F.lit(float(weights[1])) * prox


def effective_weight(
    resolved: Column, rounded_score: Column, reduction: float = lexicon.RESOLUTION_WEIGHT_REDUCTION
) -> Column:
    """Resolved hedges keep ``1 - reduction * score`` of their weight (4 dp)."""
    return F.when(
        resolved & rounded_score.isNotNull(),
        round4(F.lit(1.0) - F.lit(float(reduction)) * rounded_score),
    ).otherwise(F.lit(1.0))


def ratio4(num: Column, den: Column) -> Column:
    """``round(num / den, 4)`` with half-even rounding; 0.0 when ``den`` is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(round4(num / den))


def hedge_verify_ratio(total_hedges: Column, total_verifications: Column) -> Column:
    return round4(total_hedges / F.greatest(F.lit(1), total_verifications))


def certainty_score(trur: Column, hvr: Column, late: Column, finality: Column) -> Column:
    """Composite certainty score; finality weight drops when nothing resolved."""
    fr, pr = lexicon.FINALITY_POSITION_WEIGHTS_RESOLVED
    fu, pu = lexicon.FINALITY_POSITION_WEIGHTS_UNRESOLVED
    fw = F.when(trur > 0, F.lit(fr)).otherwise(F.lit(fu))
    pw = F.when(trur > 0, F.lit(pr)).otherwise(F.lit(pu))
    return (
        trur * F.lit(lexicon.TRUR_WEIGHT)
        + (F.lit(1.0) / (F.lit(1.0) + hvr)) * F.lit(lexicon.HVR_WEIGHT)
        + (F.lit(1.0) - late) * pw
        + ((finality + F.lit(1.0)) / F.lit(2.0)) * fw
    )


def predict_certainty(total_hedges: Column, trur: Column, hvr: Column, late: Column, finality: Column) -> Column:
    """``Certain`` / ``Uncertain``.

    Zero hedges is Certain (checked first); fewer than three is Uncertain;
    otherwise the composite score decides at 0.50.
    """
    return (
        F.when(total_hedges == 0, F.lit("Certain"))
        .when(total_hedges < lexicon.MIN_HEDGES_FOR_CERTAIN, F.lit("Uncertain"))
        .when(certainty_score(trur, hvr, late, finality) >= lexicon.CERTAIN_CUTOFF, F.lit("Certain"))
        .otherwise(F.lit("Uncertain"))
    )


def expected_binary(label: Column) -> Column:
    """Ground truth for a suite label; Partially Resolved (and unknown) is null."""
    return (
        F.when(label.isin("Certain", "Resolved Uncertainty"), F.lit("Certain"))
        .when(label == F.lit("Unresolved Uncertainty"), F.lit("Uncertain"))
    )
