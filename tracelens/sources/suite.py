"""Labelled test suites: the CSV batch reader and a suite derived from tables.

The reference scores a labelled CSV suite (7 string columns, quoted text with
commas, doubled quotes and embedded newlines) split into numbered batches. The
reader here keeps that format; batches are ``batch=N`` partitions, so choosing
batches is partition pruning. Because multi-line CSV cannot be split, large
suites should be converted once to Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.functions import lexicon, text

SUITE_COLUMNS = [
    "TestCaseID",
    "Category",
    "CertaintyLevel",
    "ConfidenceTrajectory",
    "ExpectedLabel",
    "ReasoningText",
    "Explanation",
]
CORRUPT = "_corrupt_record"
SUITE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in SUITE_COLUMNS] + [T.StructField(CORRUPT, T.StringType(), True)]
)

# FIXED VALUES (ours): rules that label planted traces so both engines agree.
CATEGORIES = ["math", "logic", "coding", "science", "planning"]
TRAJECTORIES = ["rising", "falling", "flat", "oscillating"]


def _pick(values: list[str], key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int") + 1)


def _labels(u) -> list:
    return [
        F.format_string("TC%03d", u).alias("TestCaseID"),
        _pick(CATEGORIES, u).alias("Category"),
        _pick(lexicon.CERTAINTY_LEVEL_ORDER, u).alias("CertaintyLevel"),
        _pick(TRAJECTORIES, u).alias("ConfidenceTrajectory"),
        _pick(lexicon.EXPECTED_LABELS, u).alias("ExpectedLabel"),
    ]


def derived_cases(user_traces: DataFrame) -> DataFrame:
    """A suite from planted user traces: label columns by rule on ``user_id``."""
    u = F.col("user_id")
    return user_traces.select(
        *_labels(u),
        F.col("text").alias("ReasoningText"),
        F.concat(F.lit("planted from the events of user "), u.cast("string")).alias("Explanation"),
        (F.pmod(u, F.lit(4)) + 1).cast("int").alias("batch"),
    )


def derived_labels(scored: DataFrame) -> DataFrame:
    """The suite's label columns for already-scored user traces (no text needed)."""
    u = F.col("user_id")
    extra = [c for c in scored.columns if c not in ("user_id", "trace_id")]
    return scored.select(*_labels(u), (F.pmod(u, F.lit(4)) + 1).cast("int").alias("batch"), *extra)


def derived_cases_sql(user_traces_cte: str) -> str:
    """DuckDB form of :func:`derived_cases` over a CTE with ``user_id, text``."""

    def pick(values: list[str]) -> str:
        lst = "[" + ", ".join("'" + v + "'" for v in values) + "]"
        return f"{lst}[(user_id % {len(values)}) + 1]"

    return f"""
    SELECT printf('TC%03d', user_id) AS TestCaseID,
           {pick(CATEGORIES)} AS Category,
           {pick(lexicon.CERTAINTY_LEVEL_ORDER)} AS CertaintyLevel,
           {pick(TRAJECTORIES)} AS ConfidenceTrajectory,
           {pick(lexicon.EXPECTED_LABELS)} AS ExpectedLabel,
           text AS ReasoningText,
           'planted from the events of user ' || CAST(user_id AS VARCHAR) AS Explanation,
           CAST(user_id % 4 + 1 AS INTEGER) AS batch
    FROM {user_traces_cte}"""


def write_suite_csv(cases: DataFrame, path: str) -> None:
    """Write a suite as CSV batches (``batch=N`` folders), RFC-4180 quoting."""
    (
        cases.select(*SUITE_COLUMNS, "batch")
        .write.mode("overwrite")
        .partitionBy("batch")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_suite_csv(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """Read CSV batches; all batches when ``batches`` is None.

    Empty fields read as null and become ``''`` (as a dict reader gives).
    Malformed records keep their raw text in ``_corrupt_record``.
    """
    df = (
        spark.read.schema(SUITE_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    if batches:
        df = df.where(F.col("batch").isin(list(batches)))
    fixed = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SUITE_COLUMNS if c != "TestCaseID"]
    return df.select(F.col("TestCaseID"), *fixed, F.col("batch").cast("int").alias("batch"), F.col(CORRUPT))


def split_rejects(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): a reject has no id, a blank text or a corrupt record.

    The reference keeps a placeholder row with -1 counts for a failed case;
    here the bad input is routed to its own table instead, so no sentinel
    values reach the averages.
    """
    has_corrupt = CORRUPT in cases.columns
    reason = F.when(F.col("TestCaseID").isNull() | (F.col("TestCaseID") == ""), F.lit("missing_id"))
    if has_corrupt:
        reason = reason.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_record"))
    reason = reason.when(text.is_blank(F.col("ReasoningText")), F.lit("blank_text"))
    tagged = cases.withColumn("reject_reason", reason)
    valid = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = tagged.where(F.col("reject_reason").isNotNull())
    if has_corrupt:
        valid = valid.drop(CORRUPT)
    return valid, rejects
