"""Benchmark the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8). Every query runs once to warm the JVM and caches, then once timed;
results are forced through Spark's ``noop`` sink so the whole plan executes
without moving rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trace_metrics",
    "trace_metrics_user_day",
    "assign_resolutions",
    "hedge_verification_pairs",
    "document_metrics",
    "split_sentences",
    "sentence_keyword_any",
    "cases_with_metrics",
    "breakdown_ordered",
    "label_accuracy",
    "validate_requests",
    "telemetry_by_model",
    "cosine_similarity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tracelens.plans import registry
    from tracelens.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), app="tracelens-bench")
    qs = registry.queries()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in HEADLINE:
        run(name)
    # three timed runs in changing order; the median counts
    third = len(HEADLINE) // 3
    orders = [HEADLINE, HEADLINE[::-1], HEADLINE[third:] + HEADLINE[:third]]
    runs: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for order in orders:
        for name in order:
            runs[name].append(run(name))
    timings = {name: round(statistics.median(runs[name]), 3) for name in HEADLINE}

    # skew scenario, reported apart from the headline total: every event of
    # every third user keyed to one trace, scored by the size-routed hybrid
    from pyspark.sql import functions as F

    from tracelens.operators import sentence_rows as sr
    from tracelens.sources import planted

    s = planted.planted_sentences(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
    tid = F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string"))
    rows = s.select(tid.alias("trace_id"), "ts", "event_id", F.col("sentence").alias("text"))
    t0 = time.perf_counter()
    sr.score_row_traces_full(rows, ["ts", "event_id"])[0].write.format("noop").mode("overwrite").save()
    hot_sec = round(time.perf_counter() - t0, 3)

    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "flagship_traces_per_sec": round(users / timings["trace_metrics"], 1),
        "flagship_sentences_per_sec": round(events / timings["trace_metrics"], 1),
        "skew_one_third_in_one_trace_sec": hot_sec,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
