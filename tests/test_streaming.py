"""Streaming scoring equals batch scoring on the same files."""

import time

from pyspark.sql import functions as F

from tracelens.operators.score import score_traces
from tracelens.plans.common import traces
from tracelens.session import work_dir
from tracelens.streaming import sessions
from tracelens.streaming import traces as stream

from .conftest import SF_SMALL

COLS = ["trace_id", "total_hedges", "resolved_hedges", "trur", "weighted_trur", "hvr", "late_unresolved_ratio",
        "conclusion_finality", "predicted_certainty"]


def test_stream_equals_batch(spark):
    src = work_dir(spark, "t-stream-src")
    t = traces(spark, SF_SMALL, "user_day").withColumn("ts", F.col("day").cast("timestamp"))
    t.write.parquet(src)
    streamed = stream.run_trace_metrics(spark, src, t.schema, work_dir(spark, "t-out"), work_dir(spark, "t-ckpt"))
    batch = score_traces(spark.read.parquet(src))
    a = sorted(tuple(r) for r in streamed.select(*COLS).collect())
    b = sorted(tuple(r) for r in batch.select(*COLS).collect())
    assert a == b and len(a) > 0


def test_stream_restarts_from_checkpoint(spark):
    src = work_dir(spark, "t-stream-src2")
    out, ckpt = work_dir(spark, "t-out2"), work_dir(spark, "t-ckpt2")
    t = traces(spark, SF_SMALL, "user_day").withColumn("ts", F.col("day").cast("timestamp"))
    t.where(F.col("day") < "2024-01-15").write.parquet(src)
    stream.run_trace_metrics(spark, src, t.schema, out, ckpt)
    t.where(F.col("day") >= "2024-01-15").write.mode("append").parquet(src)
    final = stream.run_trace_metrics(spark, src, t.schema, out, ckpt)  # same checkpoint: only new files
    assert final.count() == t.count()
    assert final.select("trace_id").distinct().count() == t.count()


def _breakdown(spark, src, schema, lateness, files):
    name = work_dir(spark, "t-breakdown")
    out = stream.run_breakdown(spark, src, schema, "ts", f"{name}/out", f"{name}/ckpt", lateness, files)
    return sorted((r.w.start, r.predicted_certainty, r.traces, r.hedges, round(r.trur_sum, 6)) for r in out.collect())


def test_breakdown_does_not_depend_on_batches(spark):
    src = work_dir(spark, "t-stream-src3")
    t = traces(spark, SF_SMALL, "user_day").withColumn("ts", F.col("day").cast("timestamp"))
    t.repartition(4).write.parquet(src)
    whole = _breakdown(spark, src, t.schema, "40 days", None)
    assert sum(r[2] for r in whole) == t.count()
    assert _breakdown(spark, src, t.schema, "40 days", 1) == whole


def test_late_rows_are_dropped_as_documented(spark):
    src = work_dir(spark, "t-stream-src4")
    t = traces(spark, SF_SMALL, "user_day").withColumn("ts", F.col("day").cast("timestamp"))
    last = t.agg(F.max("day")).first()[0]
    for _ in range(2):  # a watermark counts from the second batch after its rows
        t.where(F.col("day") == last).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in order of their time
    t.where(F.col("day") < F.date_sub(F.lit(last), 10)).coalesce(1).write.mode("append").parquet(src)
    kept = _breakdown(spark, src, t.schema, "1 day", 1)
    assert {r[0].date() for r in kept} == {last}


HEDGE, CHECK = "Maybe the red box is big.", "Let me verify the box."


def _arrivals(spark):
    """Rows of three traces over ten days, each with a quiet day in between."""
    rows, n = [], 0
    for trace in ("a", "b", None):
        for day in (1, 2, 4, 5, 8):
            for hour in range(0, 20, 4):
                n += 1
                rows.append((trace, f"2024-03-0{day} {hour:02d}:10:00", n, [HEDGE, CHECK, "Then.\nSo it is."][n % 3]))
    df = spark.createDataFrame(rows, "trace_id string, ts string, row_id long, text string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _session_rows(out):
    return sorted(map(str, out.select("trace_id", "session_start", "n_rows", *COLS[1:]).collect()))


def test_sessions_do_not_depend_on_deliveries(spark):
    rows = _arrivals(spark).unionByName(spark.createDataFrame([("end", "2024-03-20 00:00:00", 999, "x")], "trace_id string, ts string, row_id long, text string").withColumn("ts", F.col("ts").cast("timestamp")))
    found = []
    for cuts in (["2024-03-30"], ["2024-03-02 09:00:00", "2024-03-04 01:00:00", "2024-03-08 05:00:00", "2024-03-30"]):
        base = work_dir(spark, "t-sessions")
        before = "2000-01-01"
        for k, cut in enumerate(cuts):
            sessions.deliver(rows.where((F.col("ts") >= before) & (F.col("ts") < cut)), f"{base}/rows", k)
            before = cut
            # a new start each time, from the checkpoint
            out = sessions.run_sessions(spark, f"{base}/rows", f"{base}/out", f"{base}/ckpt", "12 hours", "1 hours", max_rows=4000 if len(cuts) > 1 else 3)
        found.append(_session_rows(out))
        assert sessions.late_rows(spark, f"{base}/rows", f"{base}/out", "12 hours", "1 hours").count() == 0
    assert found[0] == found[1] and len(found[0]) == 9  # two days, two days and one day of each trace
    texts = [r.text for r in rows.where("trace_id = 'a' AND row_id <= 10").orderBy("ts").collect()]
    one = score_traces(spark.createDataFrame([("\n".join(texts),)], "text string")).first()
    first = out.where("trace_id = 'a'").orderBy("session_start").first()
    assert [first[c] for c in COLS[1:]] == [one[c] for c in COLS[1:]] and first.n_rows == 10


def test_rows_of_a_closed_session_come_late(spark):
    rows = _arrivals(spark).where("trace_id = 'a'")
    base = work_dir(spark, "t-late")
    run = lambda: sessions.run_sessions(spark, f"{base}/rows", f"{base}/out", f"{base}/ckpt", "12 hours", "1 hours")
    sessions.deliver(rows.where("row_id <= 12"), f"{base}/rows", 0)
    first = _session_rows(run())
    assert len(first) == 1  # the second session is still open
    late = spark.createDataFrame([("a", "2024-03-01 09:00:00", 500, CHECK), ("z", "2024-02-01 00:00:00", 501, HEDGE)], "trace_id string, ts string, row_id long, text string")
    sessions.deliver(late.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(rows.where("row_id > 12")), f"{base}/rows", 1)
    second = _session_rows(run())
    assert first[0] in second and len(second) == 2  # scored sessions stay as they are
    assert sorted(r.row_id for r in sessions.late_rows(spark, f"{base}/rows", f"{base}/out", "12 hours", "1 hours").collect()) == [500, 501]


def test_no_session_has_closed(spark):
    base = work_dir(spark, "t-open")
    sessions.deliver(_arrivals(spark).limit(0), f"{base}/rows", 0)
    assert sessions.run_sessions(spark, f"{base}/rows", f"{base}/out", f"{base}/ckpt", "12 hours", "1 hours").count() == 0
