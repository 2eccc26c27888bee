"""Skew-safe ordered scans within groups.

A window partitioned by a group key sends the whole group to one task. When one
trace can hold a third of all rows that is not acceptable, so ordered scans
are done the parallel-prefix way instead:

1. range-partition on ``(group, order)``: the partitioner samples the full
   sort key, so a hot group is split over many partitions by volume;
2. each partition is sorted, and its rows get its number and an increasing
   number; both are fixed by a reliable checkpoint in the shared checkpoint
   folder, so that a lost executor does not re-sample the range bounds;
3. a (group, partition) is then a key that no group can make hot. Positions
   come from the increasing numbers, running counts and minima from windows over
   narrow rows;
4. the per-(group, partition) totals form a small table whose prefix over the
   partition number is the carry for each partition, joined back on that key.

All of it is DataFrame code; no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.session import work_dir

PID, ROW = "_pid", "_row"
#: Bytes of a row group of stored rows.
GROUP_BYTES = 16 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared checkpoint folder) computed once.

    ``checkpoint`` writes in a second job; persisting first lets that job read
    the first job's output instead of recomputing the plan. The cache is only
    a speed-up: the returned frame reads the checkpoint files.
    """
    from pyspark import StorageLevel

    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame's rows as a Parquet table in the shared checkpoint folder.

    For wide rows: it is computed once, as by :func:`materialize`, but a task holds
    a row group at a time, and not all of its rows in the cache.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | None, each: Callable[[DataFrame], DataFrame] | None = None, within: Sequence[Column] = ()) -> DataFrame:
    """Rows in ranges of (group, order), each with its range's number and an increasing number; written.

    ``each`` makes zero or more rows of every row, which are then ordered by
    ``within``. It runs behind the shuffle, as what stands before it runs twice:
    range bounds come from a sample of all rows.

    Without an explicit count the range shuffle uses the session's shuffle
    width and AQE may merge adjacent small ranges up to its advisory size: a
    merged task still holds one contiguous, sorted key range, and a hot group
    still spans many tasks.
    """
    keys = [F.col(g) for g in group] + list(order)
    ranged = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    if each is not None:
        ranged = each(ranged)
    ranged = ranged.sortWithinPartitions(*keys, *within)
    return materialize(ranged.withColumns({PID: F.spark_partition_id(), ROW: F.monotonically_increasing_id()}))


def _carried(sums: DataFrame, group: Sequence[str], columns: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Prefixes of per-(group, partition) totals over the partitions before; null where there is none."""
    w = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*[F.col(g).alias(f"_c_{g}") for g in group], F.col(PID).alias("_c_pid"), *keep, *[c.over(w).alias(name) for name, c in columns.items()])


def _with_carry(df: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    same = F.col(PID) == F.col("_c_pid")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    return df.join(carry, same, "left").drop("_c_pid", *[f"_c_{g}" for g in group])


def group_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str, n: int | None = None) -> DataFrame:
    """0-based dense row number within ``group`` by ``order`` (order must be
    unique within a group), without ever placing a group in one task. Rows of
    a null group are one group."""
    return number_flagged(df, group, order, out, [], n)[0]


def number_flagged(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str, flags: Sequence[str], n: int | None = None,
    each: Callable[[DataFrame], DataFrame] | None = None, within: Sequence[Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """Numbered rows, and those of them with a flag with counts: ``(all, flagged)``.

    ``flagged`` holds the rows where one of the boolean columns ``flags`` is
    true, and for each flag ``<out>_<flag>``: the number of rows up to and
    including this one (within the group, in order) where it is true.
    The rows are those that ``each`` makes of ``df``, if it is given, ordered
    by ``within`` among rows of the same order.
    """
    rows = _ranged(df, group, order, n, each, within)
    columns = [c for c in rows.columns if c not in (PID, ROW)]
    flag_sums = [F.count_if(F.col(f)).alias(f"_n_{f}") for f in flags]
    sums = rows.groupBy(*group, PID).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_cnt"), *flag_sums)
    offsets = _carried(sums, group, {"_off": F.sum("_cnt"), **{f"_off_{f}": F.sum(f"_n_{f}") for f in flags}}, ["_first"])
    offsets = offsets.fillna(0, ["_off", *[f"_off_{f}" for f in flags]])
    joined = _with_carry(rows, offsets, group)
    number = (F.col(ROW) - F.col("_first") + F.col("_off")).alias(out)
    everything = joined.select(*columns, number)
    if not flags:
        return everything, everything
    w = Window.partitionBy(*group, PID).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    some = F.lit(False)
    for f in flags:
        some |= F.coalesce(F.col(f), F.lit(False))
    counts = [(F.count_if(F.col(f)).over(w) + F.col(f"_off_{f}")).alias(f"{out}_{f}") for f in flags]
    return everything, joined.where(some).select(*columns, number, *counts)


def suffix_min(values: DataFrame, queries: DataFrame, group: Sequence[str], n: int | None = None) -> DataFrame:
    """For each query row, the minimum ``value`` over value rows of the same
    group whose ``key`` is >= the query's ``key``.

    ``values``: ``group..., key, value``; ``queries``: ``group..., key, qid``
    (``qid`` any struct identifying the query; ``value`` of any ordered type).
    Returns ``qid, answer`` (null when no value qualifies). Value rows sort before query rows at equal keys,
    so equality counts.
    """
    qtype, vtype = queries.schema["qid"].dataType, values.schema["value"].dataType
    v = values.select(*group, F.col("key").cast("double").alias("_k"), F.lit(0).alias("_t"),
                      F.col("value").alias("_v"), F.lit(None).cast(qtype).alias("qid"))
    q = queries.select(*group, F.col("key").cast("double").alias("_k"), F.lit(1).alias("_t"),
                       F.lit(None).cast(vtype).alias("_v"), F.col("qid"))
    rows = _ranged(v.unionByName(q), group, [F.col("_k").desc(), F.col("_t").asc()], n)
    lows = rows.groupBy(*group, PID).agg(F.min("_v").alias("_pm"))
    carry = _carried(lows, group, {"_carry": F.min("_pm")})
    w = Window.partitionBy(*group, PID).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(*group, PID, "_t", "qid", F.min("_v").over(w).alias("_run"))
    hits = _with_carry(run.where(F.col("_t") == 1), carry, group)
    return hits.select("qid", F.least(F.col("_run"), F.col("_carry")).alias("answer"))
