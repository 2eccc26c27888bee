"""Near-duplicate vectors within a label, by quantised tile products with error bounds.

Equal vectors of a label are one node first. A label's nodes are dealt to
blocks of about ``BLOCK`` by hash, and each pair of blocks is a tile, which
one task multiplies. Vectors are scaled to length one and rounded to signed
8-bit numbers with one scale per vector; the length of what rounding took away
bounds the error of every product:

    |x.y - sx sy qx.qy| <= ex |y| + |sx qx| ey <= ex + (1 + ex) ey.

Only pairs whose product could reach the threshold are computed again in
double precision. A tile gives back one row per linked vector and a spanning
forest of its links, never the pairs. All pairs of a label are compared, so
the work grows with the square of a label's distinct vectors; hashing deals
it evenly over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

THRESHOLD, BLOCK = 0.93, 1024
TILE_SCHEMA = "node long, other long, n_links long"


def usable(label: Column, vector: Column) -> Column:
    """Whether a vector takes part: neither it, its label nor a component is null, all are finite, one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows, their scales, and upper bounds of the rounding errors' lengths."""
    scale = np.abs(unit).max(1, keepdims=True) / 127
    q = np.rint(unit / scale).astype(np.int8)
    error = np.linalg.norm(unit - q * scale, axis=1) * (1 + 1e-9) + 1e-12
    return q, scale[:, 0], error


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) with a cosine of at least ``threshold``, decided in double precision."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    # products of 8-bit numbers add up exactly in single precision for up to 1,040 components
    exact = np.float32 if x.shape[1] <= 1040 else np.float64
    product = (qx.astype(exact) @ qy.astype(exact).T) * sx[:, None] * sy[None, :]
    bound = ex[:, None] + (1 + ex)[:, None] * ey[None, :] + 1e-9
    i, j = np.nonzero(product + bound >= threshold)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        s = slice(k, k + 100_000)
        keep[s] = np.einsum("kd,kd->k", x[i[s]], y[j[s]]) / (nx[i[s]] * ny[j[s]]) >= threshold
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` numbers the smallest one it is connected with by pairs (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only rows of equal label and equal vector length are compared. Repeated
    rows are linked like any others. Rows that cannot take part (``usable``)
    have no links and are their own component. A component's id is its
    smallest id that is not null.
    """
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))
    rows = rows.withColumn("node", F.when(usable(F.col("label"), F.col("v")), F.xxhash64("label", "v")))
    nodes = written(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")),
        "vectors",
    ).withColumn("dims", F.size("v"))
    blocks = nodes.groupBy("label", "dims").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = nodes.join(blocks, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "dims", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "node", "copies", "v"
    )

    def tile(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at = group.column("block").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
        left = np.flatnonzero(at == at.min())
        right = np.flatnonzero(at == at.max())
        ti, tj = group.column("ti")[0].as_py(), group.column("tj")[0].as_py()
        if ti != tj and at.min() == at.max():
            left = right[:0]  # one of the two blocks has no vectors
        i, j = linked_pairs(x[left], x[right], threshold) if len(left) else (left, left)
        i, j = left[i], right[j]
        if ti == tj:
            i, j = i[i != j], j[i != j]  # both orders are there
            links = np.bincount(i, copies[j], len(at))
        else:
            links = np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
        low = forest(i, j, len(at))
        own = np.flatnonzero(links)
        return pa.table([pa.array(node[own]), pa.array(node[low[own]]), pa.array(links[own].astype(np.int64))], names=["node", "other", "n_links"])

    found = written(tiles.groupBy("label", "dims", "ti", "tj").applyInArrow(tile, TILE_SCHEMA), "links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("others"))
    component = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "copies", "first_id").join(links, "node", "left").join(component, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    # a table of its own, so that the join can split a vector that many rows share
    out = rows.select("vec_id", "node").join(written(named, "named"), "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT * FROM rows WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.r AS a, y.r AS b FROM good x JOIN good y ON x.label = y.label AND x.r <> y.r AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
reach(r, s) AS (SELECT r, r FROM rows UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.s),
named AS (SELECT reach.r, min(rows.vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.s GROUP BY reach.r),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN named USING (r) LEFT JOIN counted USING (r)
"""
