"""Traces that arrive row by row: event-time sessions, scored when they close.

The rows lie in a table of their own, ``<source>/batch=<n>``, which others
append to. The stream keeps per open session only its bounds and count
(``session_window``), never its rows, so that a trace with many rows is no
large state. A session is closed when the watermark has passed its last row by
``gap``; its rows are then read from the table and scored by the scorer that
routes traces by size, which never gathers a long one.

Which rows count: those in the session's time range that have arrived by the
time it closes, also if the watermark had passed them. Rows that come later are
not scored; :func:`late_rows` lists them. Each micro-batch writes its own
folder, so a batch that is run again after a failure replaces its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelens.operators import joins, sentence_rows

#: Columns of a table of rows besides its batch; ``ts`` is the event time, ``row_id`` orders rows of one time.
ROW_SCHEMA = "trace_id string, ts timestamp, row_id long, text string"
#: Rows are deliveries in folders ``batch=<n>``.
SOURCE_SCHEMA = f"{ROW_SCHEMA}, batch int"


def deliver(rows: DataFrame, source_dir: str, batch: int) -> None:
    """Add ``rows`` as delivery ``batch``; the same delivery made again replaces itself."""
    rows.select(*[c.split()[0] for c in ROW_SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{source_dir}/batch={batch}")


def _rows(spark: SparkSession, source_dir: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMA).option("basePath", source_dir).parquet(source_dir)


def _within(rows: DataFrame, sessions: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the sessions of their trace whose range holds them and whose close had seen them."""
    r, s = rows.alias("r"), sessions.alias("s")
    inside = F.col("r.trace_id").eqNullSafe(F.col("s.trace_id")) & (F.col("r.ts") >= F.col("s.session_start")) & (F.col("r.ts") < F.col("s.session_end"))
    return r.join(s, inside & (F.col("r.batch") <= F.col("s.seen")), how)


def score_sessions(rows: DataFrame, sessions: DataFrame, max_rows: int = sentence_rows.ONE_ROW_LIMIT) -> DataFrame:
    """Metrics of each of ``sessions`` (trace_id, session_start, session_end, seen) from its rows: trace_id, session_start, n_rows and the ten metrics."""
    own = _within(rows, sessions, "inner").select("r.*", "s.session_start")
    # a trace's sessions are traces of their own
    name = F.concat(F.unix_micros("session_start").cast("string"), F.coalesce(F.concat(F.lit("/"), F.col("trace_id")), F.lit("")))
    named = own.withColumns({"source_id": F.col("trace_id"), "trace_id": name})
    metrics, _ = sentence_rows.score_row_traces_full(named, ["ts", "row_id"], "text", max_rows, ["source_id", "session_start"])
    counts = named.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_rows"))
    out = metrics.join(counts, "trace_id").withColumn("trace_id", F.col("source_id"))
    return out.select("trace_id", "session_start", "n_rows", *sentence_rows.METRIC_COLS)


def run_sessions(
    spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, gap: str, lateness: str, max_rows: int = sentence_rows.ONE_ROW_LIMIT, files_per_batch: int | None = None
) -> DataFrame:
    """Score the sessions that close with what has been delivered; returns all results so far.

    Goes on where the last run with ``checkpoint_dir`` ended. Rows more than
    ``lateness`` older than the newest open no session.
    """
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source_dir).withWatermark("ts", lateness)
    open_sessions = rows.groupBy("trace_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))

    def close(batch: DataFrame, batch_id: int) -> None:
        everything = _rows(spark, source_dir)
        seen = everything.agg(F.max("batch")).first()[0]
        path = f"{sink_dir}/sessions/batch_id={batch_id}"
        closed = batch.select("trace_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), F.lit(seen).cast("int").alias("seen"))
        closed.write.mode("overwrite").parquet(path)
        closed = spark.read.schema(closed.schema).parquet(path)
        if not closed.isEmpty():
            score_sessions(everything, closed, max_rows).write.mode("overwrite").parquet(f"{sink_dir}/metrics/batch_id={batch_id}")

    q = open_sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir).foreachBatch(close).trigger(availableNow=True).start()
    q.awaitTermination()
    return results(spark, sink_dir, score_schema(spark))


def score_schema(spark: SparkSession) -> StructType:
    cols = ["int", "int", "int", "double", "double", "int", "double", "double", "double", "string"]
    fields = ", ".join(f"{c} {t}" for c, t in zip(sentence_rows.METRIC_COLS, cols, strict=True))
    return spark.createDataFrame([], f"trace_id string, session_start timestamp, n_rows long, {fields}").schema


def results(spark: SparkSession, sink_dir: str, schema: StructType) -> DataFrame:
    """All metrics written so far; none before the first session closes."""
    try:
        return spark.read.schema(schema).parquet(f"{sink_dir}/metrics")
    except Exception as missing:  # noqa: BLE001 - no session has closed yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def late_rows(spark: SparkSession, source_dir: str, sink_dir: str, gap: str, lateness: str) -> DataFrame:
    """Rows that are in no scored session although the watermark has passed theirs: they came too late."""
    schema = "trace_id string, session_start timestamp, session_end timestamp, seen int"
    scored = spark.read.schema(schema).parquet(f"{sink_dir}/sessions")
    rows = _rows(spark, source_dir)
    newest = rows.agg(F.max("ts")).first()[0]
    left = _within(rows, scored, "left_anti")
    waiting = left.groupBy("trace_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # a filter on the window would otherwise be pushed below the merging of sessions
    past = joins.barrier(waiting).where(F.col("w.end") <= F.lit(newest) - F.expr(f"INTERVAL {lateness}")).select("trace_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), F.lit(2**31 - 1).alias("seen"))
    return _within(left, past, "left_semi")
