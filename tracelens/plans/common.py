"""Shared inputs for the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tracelens.operators import score
from tracelens.sources import planted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-heavy table; a local session spreads it over its cores.

    The small files of a local run are one row group, which reads as one task
    that would do all sentence splitting. On a cluster the scan's own splits
    are used and no text is shuffled.
    """
    df = table(spark, sf_dir, name)
    if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def traces(spark: SparkSession, sf_dir: str, key: str = "user_day") -> DataFrame:
    return planted.planted_traces(spark, table(spark, sf_dir, "events"), key)


def scored(spark: SparkSession, sf_dir: str, key: str = "user_day") -> DataFrame:
    return score.score_traces(traces(spark, sf_dir, key))


def sentence_rows(spark: SparkSession, sf_dir: str, key: str = "user_day") -> DataFrame:
    """Planted traces as ``(trace_id, pos, sentence)`` rows, numbered skew-safely
    (no trace is ever gathered into one task)."""
    from tracelens.operators import sentence_rows as sr

    return sr.planted_sentence_rows(spark, table(spark, sf_dir, "events"), key)


def row_statements(spark: SparkSession, sf_dir: str, key: str = "user_day") -> tuple[DataFrame, DataFrame]:
    """(hedges, verifications) as rows with ids, positions and subjects."""
    from tracelens.operators import sentence_rows as sr

    _, hedges, vers = sr.planted_statements(spark, table(spark, sf_dir, "events"), key)
    return hedges, vers


def scored_rows(spark: SparkSession, sf_dir: str, key: str = "user_day") -> tuple[DataFrame, DataFrame]:
    """(metrics, matches) of planted traces by the size-routed hybrid scorer:
    short traces gathered and folded in one row, long ones scored from rows."""
    from tracelens.operators import sentence_rows as sr

    rows = sr.planted_rows(spark, table(spark, sf_dir, "events"), key)
    return sr.score_row_traces_full(rows, ["ts", "event_id"], keys=planted.TRACE_KEYS[key])
