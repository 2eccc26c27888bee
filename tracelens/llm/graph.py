"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task may hold; as many or fewer are not dealt to tasks by key in each round.
ONE_PART = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it is connected with.

    Large-star and small-star steps in turn: each points all larger neighbours
    of a node, then all smaller ones, at the smallest of them, until every
    edge points at its component's smallest node. Each round is written to the
    shared folder, and the driver sees only a count and a checksum. Up to
    ``ONE_PART`` edges are one part, so that rounds over few edges do not cost
    shuffles, files and tasks for each partition. A node without edges to
    others does not appear.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, few = state, state[0] <= ONE_PART
        now = now.coalesce(1) if few else now
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(b.alias("a"), a.alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.union(least.select("a", F.col("m").alias("b")))
        now = written((after.coalesce(1) if few else after).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
