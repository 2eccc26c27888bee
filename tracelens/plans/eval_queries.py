"""Registered suite-evaluation queries and oracles.

The labelled suite is derived from planted user traces (labels by rule on
``user_id``), scored with the flagship transform, then summarised. The CSV
and report queries write their intermediate files under the session's shared
checkpoint folder and read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import lexicon, scoring
from tracelens.operators import evaluate as ev
from tracelens.plans import oracle_sql as o
from tracelens.plans.common import scored_rows, table, traces
from tracelens.session import work_dir
from tracelens.sources import suite

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------
def cases(spark: SparkSession, sf: str) -> DataFrame:
    return suite.derived_cases(traces(spark, sf, "user"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-case results: labels by rule, metrics from the size-routed hybrid
    scorer (the case text is not needed, so no trace is gathered unbounded)."""
    metrics, _ = scored_rows(spark, sf, "user")
    return ev.cases_with_metrics(suite.derived_labels(metrics))


def requested_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Requested case IDs, lower-cased: one per labelled document id."""
    c = table(spark, sf, "labels")
    return c.select(F.lower(F.format_string("tc%03d", F.col("doc_id"))).alias("id")).distinct()


RESULT_COLS = (
    "TestCaseID, Category, CertaintyLevel, ConfidenceTrajectory, ExpectedLabel, batch, total_hedges, resolved_hedges, "
    "unresolved_hedges, trur, weighted_trur, total_verifications, hvr, late_unresolved_ratio, conclusion_finality, "
    "predicted_certainty"
)

SUITE_SQL = (
    o.trace_ctes("user")
    + f""",
cases AS ({suite.derived_cases_sql('tsplit')}),
results AS (
  SELECT c.TestCaseID, c.Category, c.CertaintyLevel, c.ConfidenceTrajectory, c.ExpectedLabel, c.batch,
         m.total_hedges, m.resolved_hedges, m.unresolved_hedges, m.trur, m.weighted_trur,
         coalesce(m.total_verifications, 0) AS total_verifications, coalesce(m.hvr, 0.0) AS hvr,
         coalesce(m.late_unresolved_ratio, 0.0) AS late_unresolved_ratio,
         coalesce(m.conclusion_finality, 0.0) AS conclusion_finality,
         coalesce(m.predicted_certainty, '?') AS predicted_certainty
  FROM metrics m JOIN cases c ON c.TestCaseID = printf('TC%03d', m.user_id)),
truth AS (
  SELECT *, CASE WHEN ExpectedLabel IN ('Certain', 'Resolved Uncertainty') THEN 'Certain'
                 WHEN ExpectedLabel = 'Unresolved Uncertainty' THEN 'Uncertain' END AS truth,
            coalesce(ExpectedLabel IN ({', '.join(o.q(x) for x in lexicon.EXPECTED_LABELS)}), false) AS known
  FROM results),
judged AS (
  SELECT *, known AND (CASE WHEN truth IS NULL THEN true ELSE predicted_certainty = truth END) AS correct
  FROM truth WHERE predicted_certainty IN ({', '.join(o.q(x) for x in lexicon.PREDICTED_LABELS)})),
label_dim AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, {o.q(lbl)})" for i, lbl in enumerate(lexicon.EXPECTED_LABELS))}) t(label_order, ExpectedLabel))
"""
)

AVGS = ", ".join(
    f"{o.round4(f'avg({src})')} AS {name}" for name, src in ev.BREAKDOWN_AGGS
)


@register("cases_with_metrics", SUITE_SQL + f" SELECT {RESULT_COLS} FROM results")
def q_cases_with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf)


@register(
    "run_summary",
    SUITE_SQL
    + f""" SELECT count(*) AS cases,
              coalesce({o.round4('avg(total_hedges)')}, 0.0) AS avg_hedges,
              coalesce({o.round4('avg(resolved_hedges)')}, 0.0) AS avg_resolved,
              coalesce({o.round4('avg(trur)')}, 0.0) AS avg_trur,
              coalesce({o.round4('avg(weighted_trur)')}, 0.0) AS avg_weighted_trur,
              CAST(count_if(total_hedges = 0) AS BIGINT) AS zero_hedge_cases,
              CAST(count_if(total_hedges > 0 AND resolved_hedges = total_hedges) AS BIGINT) AS fully_resolved_cases
           FROM results""",
)
def q_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run_summary(results(spark, sf))


def _rank_sql(col: str, order: list[str] | None) -> str:
    if not order:
        return "99"
    lst = "[" + ", ".join(o.q(k) for k in order) + "]"
    return f"CAST(CASE WHEN list_position({lst}, {col}) > 0 THEN list_position({lst}, {col}) ELSE 99 END AS INTEGER)"


@register(
    "breakdown_by_certainty",
    SUITE_SQL
    + f""" SELECT coalesce(CertaintyLevel, 'Unknown') AS group_key, count(*) AS cases, {AVGS},
              {_rank_sql("coalesce(CertaintyLevel, 'Unknown')", lexicon.CERTAINTY_LEVEL_ORDER)} AS sort_rank
           FROM results GROUP BY 1""",
)
def q_breakdown_by_certainty(spark: SparkSession, sf: str) -> DataFrame:
    return ev.group_breakdown(results(spark, sf), "CertaintyLevel", lexicon.CERTAINTY_LEVEL_ORDER)


@register(
    "breakdown_by_category",
    SUITE_SQL
    + f""" SELECT coalesce(Category, 'Unknown') AS group_key, count(*) AS cases, {AVGS}, 99 AS sort_rank
           FROM results GROUP BY 1""",
)
def q_breakdown_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return ev.group_breakdown(results(spark, sf), "Category")


@register(
    "breakdown_ordered",
    SUITE_SQL
    + f""" SELECT CASE WHEN grouping(level) = 0 THEN 'certainty_level' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS dimension,
              CASE WHEN grouping(level) = 0 THEN level WHEN grouping(category) = 0 THEN category ELSE 'ALL' END AS group_key,
              CASE WHEN grouping(level) = 0 THEN {_rank_sql('level', lexicon.CERTAINTY_LEVEL_ORDER)} ELSE 99 END AS sort_rank,
              count(*) AS cases, {AVGS}
           FROM (SELECT coalesce(CertaintyLevel, 'Unknown') AS level, coalesce(Category, 'Unknown') AS category, * FROM results)
           GROUP BY GROUPING SETS ((level), (category), ())""",
)
def q_breakdown_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return ev.breakdown_ordered(results(spark, sf))


@register(
    "label_accuracy",
    SUITE_SQL
    + f""" SELECT l.ExpectedLabel, l.label_order, coalesce(j.correct, 0) AS correct, coalesce(j.total, 0) AS total,
              CASE WHEN coalesce(j.total, 0) = 0 THEN 0.0 ELSE {o.round4('j.correct / j.total')} END AS accuracy
           FROM label_dim l LEFT JOIN (SELECT ExpectedLabel, count(*) AS total, CAST(count_if(correct) AS BIGINT) AS correct FROM judged GROUP BY 1) j
             ON j.ExpectedLabel = l.ExpectedLabel""",
)
def q_label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.label_accuracy(spark, results(spark, sf))


@register(
    "label_breakdown",
    SUITE_SQL
    + """ SELECT l.ExpectedLabel, l.label_order,
              count(r.TestCaseID) FILTER (WHERE r.predicted_certainty = 'Certain') AS Certain,
              count(r.TestCaseID) FILTER (WHERE r.predicted_certainty = 'Uncertain') AS Uncertain
           FROM label_dim l LEFT JOIN judged r ON r.ExpectedLabel = l.ExpectedLabel
           GROUP BY l.ExpectedLabel, l.label_order""",
)
def q_label_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return ev.label_breakdown(spark, results(spark, sf))


@register(
    "overall_accuracy",
    SUITE_SQL
    + f""" SELECT count(*) AS total_cases,
              CAST(count_if(known) AS BIGINT) AS counted,
              CAST(count_if(correct) AS BIGINT) AS correct,
              CAST(count_if(known) - count_if(correct) AS BIGINT) AS wrong,
              CASE WHEN count_if(known) > 0 THEN {o.round4("count_if(correct) / count_if(known)")} END AS accuracy
           FROM judged""",
)
def q_overall_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.overall_accuracy(results(spark, sf))


@register(
    "misclassified_cases",
    SUITE_SQL
    + " SELECT TestCaseID, ExpectedLabel, truth, predicted_certainty AS predicted FROM judged WHERE truth IS NOT NULL AND NOT correct",
)
def q_misclassified_cases(spark: SparkSession, sf: str) -> DataFrame:
    return ev.misclassified_cases(results(spark, sf))


@register("expected_binary", SUITE_SQL + " SELECT TestCaseID, ExpectedLabel, truth FROM truth")
def q_expected_binary(spark: SparkSession, sf: str) -> DataFrame:
    r = cases(spark, sf)
    return r.select("TestCaseID", "ExpectedLabel", scoring.expected_binary(F.col("ExpectedLabel")).alias("truth"))


REQ_SQL = "SELECT DISTINCT lower(printf('tc%03d', doc_id)) AS id FROM labels"


@register(
    "select_cases_by_id",
    SUITE_SQL
    + f""" SELECT TestCaseID, batch, ExpectedLabel FROM cases
           WHERE upper(TestCaseID) IN (SELECT upper(id) FROM ({REQ_SQL}))""",
)
def q_select_cases_by_id(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf).select("TestCaseID", "batch", "ExpectedLabel")
    return ev.select_cases(c, requested_ids(spark, sf))


@register(
    "missing_case_ids",
    SUITE_SQL
    + f""" SELECT DISTINCT upper(id) AS id FROM ({REQ_SQL})
           WHERE upper(id) NOT IN (SELECT upper(TestCaseID) FROM cases)""",
)
def q_missing_case_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ev.missing_case_ids(cases(spark, sf).select("TestCaseID"), requested_ids(spark, sf))


# ---------------------------------------------------------------------------
# CSV batches and report text (files written under the checkpoint folder)
# ---------------------------------------------------------------------------
def _suite_csv(spark: SparkSession, sf: str) -> str:
    path = work_dir(spark, "suite-csv")
    suite.write_suite_csv(cases(spark, sf), path)
    return path


@register(
    "scan_test_cases",
    SUITE_SQL + " SELECT TestCaseID, Category, CertaintyLevel, ConfidenceTrajectory, ExpectedLabel, ReasoningText, Explanation, batch FROM cases",
)
def q_scan_test_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Write the suite as multi-line-safe CSV batches and read them back."""
    path = _suite_csv(spark, sf)
    return suite.read_suite_csv(spark, path).drop(suite.CORRUPT)


@register(
    "union_batches",
    SUITE_SQL + " SELECT TestCaseID, batch, ExpectedLabel, CAST(length(ReasoningText) AS INTEGER) AS n_chars FROM cases",
)
def q_union_batches(spark: SparkSession, sf: str) -> DataFrame:
    """All batch folders that are there, in one scan."""
    out = suite.read_suite_csv(spark, _suite_csv(spark, sf))
    return out.select("TestCaseID", "batch", "ExpectedLabel", F.length("ReasoningText").alias("n_chars"))


@register(
    "quarantine_cases",
    SUITE_SQL
    + """ SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE printf('TC%03d', user_id) END AS TestCaseID,
              CASE WHEN user_id % 7 = 0 THEN 'missing_id' ELSE 'blank_text' END AS reject_reason
           FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 7 IN (0, 1)""",
)
def q_quarantine_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases planted bad by rule (every seventh without an id, the next with a blank text) end up in the rejects."""
    path = work_dir(spark, "suite-csv")
    bad = F.pmod(F.regexp_extract("Explanation", r"(\d+)$", 1).cast("bigint"), F.lit(7))
    planted = cases(spark, sf).withColumn("TestCaseID", F.when(bad != 0, F.col("TestCaseID")))
    planted = planted.withColumn("ReasoningText", F.when(bad == 1, F.lit(" \n ")).otherwise(F.col("ReasoningText")))
    suite.write_suite_csv(planted, path)
    _, rejects = suite.split_rejects(suite.read_suite_csv(spark, path))
    return rejects.select("TestCaseID", "reject_reason")


@register(
    "parse_report_lines",
    SUITE_SQL
    + " SELECT TestCaseID AS tc_id, ExpectedLabel AS expected, predicted_certainty AS predicted FROM results WHERE predicted_certainty IN ('Certain', 'Uncertain')",
)
def q_parse_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Write a line of text per case (id, labels, prediction, hedges), read the text back and parse it."""
    path = work_dir(spark, "report")
    line = F.concat_ws(" ", "TestCaseID", "ExpectedLabel", "predicted_certainty", "total_hedges")
    results(spark, sf).select(line.alias("value")).write.mode("overwrite").text(path)
    return ev.parse_report_lines(spark.read.text(path))
