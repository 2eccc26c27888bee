"""Skew check: a third of all event rows in one trace.

Usage: python tools/skew_demo.py [sf_dir]
Keys every event of every third user to one trace ('hot'), the rest by user,
and scores them with the size-routed hybrid: the hot trace goes through the
sentence-row scorer (range-partitioned, never in one task), the rest are
gathered. Prints timings and the hot trace's metrics.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tracelens.operators import sentence_rows as sr  # noqa: E402
from tracelens.session import local_session  # noqa: E402
from tracelens.sources import planted  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    ev = spark.read.parquet(f"{sf}/events.parquet")
    s = planted.planted_sentences(spark, ev)
    tid = F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string"))
    rows = s.select(tid.alias("trace_id"), "ts", "event_id", F.col("sentence").alias("text"))
    share = rows.where(F.col("trace_id") == "hot").count() / rows.count()
    t0 = time.perf_counter()
    metrics, _ = sr.score_row_traces_full(rows, ["ts", "event_id"])
    out = {r.trace_id: r for r in metrics.collect()}
    print(f"hot share {share:.3f}; traces {len(out)}; seconds {time.perf_counter() - t0:.1f}")
    print("hot:", out["hot"].asDict())


if __name__ == "__main__":
    main()
