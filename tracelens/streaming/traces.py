"""Structured Streaming forms of trace scoring.

Scoring a trace is a pure function of its text, so the stream is the same
narrow transform on ``readStream``: append mode, no state. The rolling
breakdown is a windowed aggregate with a watermark; late traces beyond the
watermark are dropped and closed windows leave the state store.
Checkpoints go under the session's shared checkpoint folder, so a restarted
query (or a lost executor) resumes from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelens.operators import score


def stream_trace_metrics(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Streaming DataFrame of per-trace metrics (stateless)."""
    return score.score_traces(stream, text_col=text_col)


def run_trace_metrics(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """Score every trace file in ``source_dir`` that is available now and return
    the written result table."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    q = (
        stream_trace_metrics(src)
        .writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def stream_breakdown(scored_stream: DataFrame, ts_col: str, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Per window and predicted label: traces and average hedges/TRUR."""
    return (
        scored_stream.withWatermark(ts_col, lateness)
        .groupBy(F.window(ts_col, window).alias("w"), "predicted_certainty")
        .agg(
            F.count(F.lit(1)).alias("traces"),
            F.sum("total_hedges").alias("hedges"),
            F.sum("trur").alias("trur_sum"),
        )
    )


def run_breakdown(
    spark: SparkSession, source_dir: str, schema: StructType, ts_col: str, sink_dir: str, checkpoint_dir: str,
    lateness: str = "1 day", files_per_batch: int | None = None,
) -> DataFrame:
    """Run the windowed breakdown over what is available now.

    Rows whose window closed more than ``lateness`` before the latest event
    time of earlier batches are dropped. Files that are not in order of event
    time need a lateness that covers their span; then the result does not
    depend on how files are batched (``files_per_batch``).

    Update mode emits every window a batch touches; each micro-batch appends
    its updated rows with the batch id, and the reader keeps the latest row per
    window key, which is the standard upsert over a plain Parquet sink.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    agg = stream_breakdown(stream_trace_metrics(reader.parquet(source_dir)), ts_col, lateness=lateness)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_dir)

    q = agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(sink_dir)
    latest = out.groupBy(F.col("w"), "predicted_certainty").agg(F.max_by(F.struct("traces", "hedges", "trur_sum"), "batch_id").alias("r"))
    return latest.select("w", "predicted_certainty", "r.traces", "r.hedges", "r.trur_sum")
