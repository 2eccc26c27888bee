"""Planted reasoning traces built from the driver's ``events`` table.

The driver's prose contains no hedge phrase, so trace tests use events as
sentences: each event becomes one template sentence chosen by
``(event_type, event_id % 3)`` and a trace is its events in ``(ts, event_id)``
order, keyed by user (long traces) or by user and day (short traces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: the 15-row template dimension (event_type, k, sentence).
TEMPLATES: list[tuple[str, int, str]] = [
    ("view", 0, "Maybe the checkout total is wrong."),
    ("view", 1, "Perhaps the checkout page is slow."),
    ("view", 2, "The tax rule seems odd."),
    ("error", 0, "I'm not sure about the checkout total."),
    ("error", 1, "Wait, the tax rule was skipped."),
    ("error", 2, "It remains unclear."),
    ("signup", 0, "The account is new."),
    ("signup", 1, "Perhaps check the tax table."),
    ("signup", 2, "Maybe therefore the total is fine."),
    ("click", 0, "Let me verify the checkout total."),
    ("click", 1, "Let me check the tax rule."),
    ("click", 2, "Review the page."),
    ("purchase", 0, "Therefore the total is correct."),
    ("purchase", 1, "The answer is final."),
    ("purchase", 2, "Done."),
]

TRACE_KEYS = {"user": ["user_id"], "user_day": ["user_id", "day"]}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "event_type string, k int, sentence string")



def planted_sentences(spark: SparkSession, events: DataFrame) -> DataFrame:
    """One row per event: ``(user_id, day, ts, event_id, sentence)``.

    The template side has 15 rows by construction, so broadcasting it is safe
    at any scale; the event side is never shuffled here.
    """
    ev = events.select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        F.pmod(F.col("event_id"), F.lit(3)).cast("int").alias("k"),
    )
    return ev.join(F.broadcast(templates(spark)), ["event_type", "k"]).select(
        "user_id", F.to_date("ts").alias("day"), "ts", "event_id", "sentence"
    )


def trace_id_col(key: str):
    if key == "user":
        return F.col("user_id").cast("string")
    return F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd"))


def planted_traces(spark: SparkSession, events: DataFrame, key: str = "user_day") -> DataFrame:
    """``(trace_id, <key cols>, text)``: sentences joined by a space in (ts, event_id) order.

    A trace is one text row (the reference's unit of work), so the events of one
    trace are gathered into one row; the grouping aggregates partially on the
    map side before the shuffle.
    """
    cols = TRACE_KEYS[key]
    s = planted_sentences(spark, events)
    # Scoring after this step is CPU-heavy per trace, so the trace rows keep the
    # configured shuffle width instead of letting AQE merge small partitions
    # into one task. The aggregate reuses this hash partitioning (one exchange).
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = s.repartition(n, *cols).groupBy(*cols).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "sentence"))).alias("_evs")
    )
    return grouped.select(
        trace_id_col(key).alias("trace_id"),
        *cols,
        F.array_join(F.transform("_evs", lambda e: e["sentence"]), " ").alias("text"),
    )


def planted_sentence_sql() -> str:
    """DuckDB form of :func:`planted_sentences` (for oracles): user_id, day, ts, event_id, sentence."""
    vals = ", ".join(f"('{t}', {k}, '{s.replace(chr(39), chr(39) * 2)}')" for t, k, s in TEMPLATES)
    return f"""
      SELECT e.user_id, CAST(e.ts AS DATE) AS day, e.ts, e.event_id, t.sentence
      FROM events e
      JOIN (VALUES {vals}) t(event_type, k, sentence)
        ON e.event_type = t.event_type AND CAST(((e.event_id % 3) + 3) % 3 AS INTEGER) = t.k
    """


def planted_trace_sql(key: str = "user_day") -> str:
    """DuckDB form of :func:`planted_traces` (for oracles)."""
    if key == "user":
        tid, keys, grp = "CAST(user_id AS VARCHAR)", "user_id", "user_id"
    else:
        tid = "CAST(user_id AS VARCHAR) || '/' || strftime(day, '%Y-%m-%d')"
        keys, grp = "user_id, day", "user_id, day"
    return f"""
    SELECT {tid} AS trace_id, {keys},
           string_agg(sentence, ' ' ORDER BY ts, event_id) AS text
    FROM ({planted_sentence_sql()}) s
    GROUP BY {grp}
    """
