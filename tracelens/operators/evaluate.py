"""Suite evaluation: per-case results, summaries, group breakdowns, accuracy.

All of it is group-bys over the typed per-case table (partial aggregation on
the map side, so a hot group never lands whole in one task) plus joins with
the four-row label dimension, which is broadcast because its size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import lexicon, scoring

CASE_LABEL_COLUMNS = ["TestCaseID", "Category", "CertaintyLevel", "ConfidenceTrajectory", "ExpectedLabel"]


def cases_with_metrics(scored_cases: DataFrame) -> DataFrame:
    """Per-case result row with the batch runner's defaults for missing fields."""
    extra = [c for c in ("batch",) if c in scored_cases.columns]
    return scored_cases.select(
        *CASE_LABEL_COLUMNS,
        *extra,
        "total_hedges",
        "resolved_hedges",
        "unresolved_hedges",
        "trur",
        "weighted_trur",
        F.coalesce("total_verifications", F.lit(0)).alias("total_verifications"),
        F.coalesce("hvr", F.lit(0.0)).alias("hvr"),
        F.coalesce("late_unresolved_ratio", F.lit(0.0)).alias("late_unresolved_ratio"),
        F.coalesce("conclusion_finality", F.lit(0.0)).alias("conclusion_finality"),
        F.coalesce("predicted_certainty", F.lit("?")).alias("predicted_certainty"),
    )


def _avg4(c: str) -> Column:
    return scoring.round4(F.avg(c))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: cases, averages (4 dp), zero-hedge and fully-resolved counts."""
    th, rh = F.col("total_hedges"), F.col("resolved_hedges")
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(_avg4("total_hedges"), F.lit(0.0)).alias("avg_hedges"),
        F.coalesce(_avg4("resolved_hedges"), F.lit(0.0)).alias("avg_resolved"),
        F.coalesce(_avg4("trur"), F.lit(0.0)).alias("avg_trur"),
        F.coalesce(_avg4("weighted_trur"), F.lit(0.0)).alias("avg_weighted_trur"),
        F.count_if(th == 0).alias("zero_hedge_cases"),
        F.count_if((th > 0) & (rh == th)).alias("fully_resolved_cases"),
    )


BREAKDOWN_AGGS = [
    ("avg_hedges", "total_hedges"),
    ("avg_resolved", "resolved_hedges"),
    ("avg_verifications", "total_verifications"),
    ("avg_hvr", "hvr"),
    ("avg_trur", "trur"),
    ("avg_weighted_trur", "weighted_trur"),
]


def _breakdown_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("cases")] + [_avg4(src).alias(name) for name, src in BREAKDOWN_AGGS]


def order_rank(key: Column, key_order: list[str] | None) -> Column:
    """Position in ``key_order`` (1-based); keys outside it rank 99 (then by name)."""
    if not key_order:
        return F.lit(99)
    pos = F.array_position(F.array(*[F.lit(k) for k in key_order]), key)
    return F.when(pos > 0, pos.cast("int")).otherwise(F.lit(99))


def group_breakdown(results: DataFrame, group_key: str, key_order: list[str] | None = None) -> DataFrame:
    """Per-group case count and averages; a missing key groups as ``Unknown``."""
    g = results.withColumn("group_key", F.coalesce(F.col(group_key), F.lit("Unknown")))
    out = g.groupBy("group_key").agg(*_breakdown_aggs())
    return out.withColumn("sort_rank", order_rank(F.col("group_key"), key_order))


def breakdown_ordered(results: DataFrame) -> DataFrame:
    """Certainty-level groups, category groups and the total in one pass.

    ``GROUPING SETS ((level), (category), ())`` scans and shuffles once. Rows
    carry a ``sort_rank`` (High, Medium, Low first for levels; the rest by name).
    """
    g = results.select(
        F.coalesce("CertaintyLevel", F.lit("Unknown")).alias("level"),
        F.coalesce("Category", F.lit("Unknown")).alias("category"),
        *[F.col(src) for _, src in BREAKDOWN_AGGS],
    )
    gs = g.groupingSets([["level"], ["category"], []], "level", "category").agg(
        F.grouping_id().alias("_gid"), *_breakdown_aggs()
    )
    dim = (
        F.when(F.col("_gid") == 1, F.lit("certainty_level"))
        .when(F.col("_gid") == 2, F.lit("category"))
        .otherwise(F.lit("total"))
    )
    key = F.when(F.col("_gid") == 1, F.col("level")).when(F.col("_gid") == 2, F.col("category")).otherwise(F.lit("ALL"))
    rank = F.when(F.col("_gid") == 1, order_rank(F.col("level"), lexicon.CERTAINTY_LEVEL_ORDER)).otherwise(F.lit(99))
    return gs.select(
        dim.alias("dimension"),
        key.alias("group_key"),
        rank.alias("sort_rank"),
        "cases",
        *[name for name, _ in BREAKDOWN_AGGS],
    )


def sort_breakdown(df: DataFrame) -> DataFrame:
    """Report order: custom rank first, then alphabetical."""
    return df.orderBy("sort_rank", "group_key")


# ---------------------------------------------------------------------------
# Accuracy
# ---------------------------------------------------------------------------
def label_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, lbl) for i, lbl in enumerate(lexicon.EXPECTED_LABELS)]
    return spark.createDataFrame(rows, "label_order int, ExpectedLabel string")


def judged(results: DataFrame) -> DataFrame:
    """Rows the accuracy report counts, with ``truth``, ``known`` and ``correct``.

    Only rows with a known prediction (Certain / Uncertain) are counted, as the
    report reader skips any other line. ``known`` marks a known expected label;
    rows without one are kept for the case total but never counted as correct.
    Partially Resolved has no truth and is correct for either prediction.
    """
    truth = scoring.expected_binary(F.col("ExpectedLabel"))
    known = F.coalesce(F.col("ExpectedLabel").isin(lexicon.EXPECTED_LABELS), F.lit(False))
    rows = results.where(F.col("predicted_certainty").isin(lexicon.PREDICTED_LABELS))
    return (
        rows.withColumn("truth", truth)
        .withColumn("known", known)
        .withColumn("correct", known & F.when(truth.isNull(), F.lit(True)).otherwise(F.col("predicted_certainty") == truth))
    )




def label_accuracy(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Per expected label: correct, total, accuracy. All four labels appear."""
    dim = label_dimension(spark)
    per = judged(results).groupBy("ExpectedLabel").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct")
    )
    # at most one row per known label after the semi-join: a proven broadcast size
    known = per.join(F.broadcast(dim.select("ExpectedLabel")), "ExpectedLabel", "left_semi")
    j = dim.join(F.broadcast(known), "ExpectedLabel", "left")
    total = F.coalesce("total", F.lit(0))
    correct = F.coalesce("correct", F.lit(0))
    return j.select(
        "ExpectedLabel",
        "label_order",
        correct.alias("correct"),
        total.alias("total"),
        scoring.ratio4(correct, total).alias("accuracy"),
    )


def label_breakdown(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Per expected label, count of each predicted label (pivot, zeros filled)."""
    dim = label_dimension(spark)
    piv = judged(results).groupBy("ExpectedLabel").pivot("predicted_certainty", lexicon.PREDICTED_LABELS).count()
    known = piv.join(F.broadcast(dim.select("ExpectedLabel")), "ExpectedLabel", "left_semi")
    j = dim.join(F.broadcast(known), "ExpectedLabel", "left")
    return j.select(
        "ExpectedLabel",
        "label_order",
        *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in lexicon.PREDICTED_LABELS],
    )


def overall_accuracy(results: DataFrame) -> DataFrame:
    """Cases, counted, correct, wrong and accuracy (null on an empty input)."""
    t = judged(results)
    a = t.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if("known").alias("counted"),
        F.count_if("correct").alias("correct"),
    )
    return a.select(
        "total_cases",
        "counted",
        "correct",
        (F.col("counted") - F.col("correct")).alias("wrong"),
        F.when(F.col("counted") > 0, scoring.round4(F.col("correct") / F.col("counted"))).alias("accuracy"),
    )


def misclassified_cases(results: DataFrame) -> DataFrame:
    t = judged(results)
    return t.where(F.col("truth").isNotNull() & ~F.col("correct")).select(
        "TestCaseID", "ExpectedLabel", "truth", F.col("predicted_certainty").alias("predicted")
    )


def select_cases(cases: DataFrame, requested_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Cases whose ID is requested, case-insensitively (left-semi join)."""
    req = requested_ids.select(F.upper(F.col(id_col)).alias("_rid")).distinct()
    return cases.join(req, F.upper(F.col("TestCaseID")) == F.col("_rid"), "left_semi")


def missing_case_ids(cases: DataFrame, requested_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Requested IDs (upper-cased) that match no case (left-anti join)."""
    req = requested_ids.select(F.upper(F.col(id_col)).alias("id")).distinct()
    found = cases.select(F.upper(F.col("TestCaseID")).alias("id"))
    return req.join(found, "id", "left_anti")


# ---------------------------------------------------------------------------
# Report lines (legacy text reports)
# ---------------------------------------------------------------------------
def parse_report_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(tc_id, expected, predicted)`` from report text lines.

    A line counts when it starts with ``TC``, has at least three tokens and its
    second-last token is a known prediction; the expected label is the first of
    the four labels (in list order) contained in the line.
    """
    line = F.rtrim(F.col(col))
    parts = F.split(line, r"\s+")
    known = F.array(*[F.lit(p) for p in lexicon.PREDICTED_LABELS])
    labels = F.array(*[F.lit(l) for l in lexicon.EXPECTED_LABELS])
    cand = lines.select(line.alias("line"), parts.alias("parts"))
    parsed = cand.select(
        F.get(F.col("parts"), 0).alias("tc_id"),
        F.get(F.filter(labels, lambda l: F.contains(F.col("line"), l)), 0).alias("expected"),
        F.get(F.col("parts"), F.size("parts") - 2).alias("predicted"),
        F.col("line").startswith("TC").alias("_tc"),
        F.size("parts").alias("_n"),
    )
    return parsed.where(
        F.col("_tc") & (F.col("_n") >= 3) & F.array_contains(known, F.col("predicted"))
    ).select("tc_id", "expected", "predicted")
