"""Hard negatives by slots between the positives' upper limits.

Anchors are held against all rows in tiles: anchors and rows are dealt to
blocks, and a task multiplies one block with another. So no label, however
many rows it has, and no anchor meets all its rows in one task.

1. Positives: tiles of one label give each anchor its best rows of the tile;
   a rank limit, applied before and after the shuffle, leaves the first
   ``positives`` of all.
2. Slots: a positive's upper limit is the highest score that a negative may
   have for it. An anchor's distinct upper limits, from high to low, cut the
   scores into disjoint slots: slot k holds what lies at or below limit k and
   above limit k + 1.
3. Combiners: a tile of an anchor block and a row block keeps, for each anchor
   and slot, the first ``negatives`` rows of other labels; a rank limit on
   (anchor, slot) does the same over all tiles.
4. Suffix merges: from the highest slot down, a positive's window starts at
   its own slot. What is first there and in the slots below, in that order, and
   not under its lower limit, answers it; windows overlap, yet no row is kept
   more than once per anchor.

Scores are exact 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

POSITIVES, NEGATIVES = 5, 10
#: Limits of a negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
SCALE = 256
#: Rows and anchors of a block.
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 4_096
#: Scaled components are held within these bounds, so that a score has 64 bits.
BOUND = 1 << 27
FOUND_SCHEMA = "anchor long, row long, id long, score long"
SLOT_SCHEMA = "anchor long, slot int, row long, id long, score long"


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part: neither label nor vector nor a component is null, and all are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite, F.lit(False))


def prepared(vectors: DataFrame, label: Column, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows that take part: row, id, label, v (components as whole numbers of 1 / ``scale``), dims; written."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))
    rows = vectors.where(usable(F.col(label_col), v)).select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), whole.alias("v"))
    # the number tells rows of one id apart; it is fixed by being written
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "whole-vectors").withColumn("dims", F.size("v"))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if top < 2**53:  # every partial sum is a whole number that doubles hold
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def first_of(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    if len(score) > n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:n]


def _vectors(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _ids(t: pa.Table) -> np.ndarray:
    """Ids, with a null id behind all others."""
    return t.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()


def _dealt(rows: DataFrame, anchors: DataFrame, keys: list[str], row_block: int, anchor_block: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with their tiles: each row once per block of anchors, each anchor once per block of rows."""
    n_rows = rows.groupBy(*keys).agg(F.ceil(F.count("*") / row_block).alias("row_blocks"))
    n_anchors = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / anchor_block).alias("anchor_blocks"))
    blocks = written(n_rows.join(n_anchors, keys), "tile-counts")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    r = rows.join(blocks, keys).withColumn("rb", F.pmod(F.xxhash64("row"), F.col("row_blocks"))).withColumn("ab", every("anchor_blocks"))
    a = anchors.join(blocks, keys).withColumn("ab", F.pmod(F.xxhash64("row", F.lit(1)), F.col("anchor_blocks"))).withColumn("rb", every("row_blocks"))
    return r.drop("row_blocks", "anchor_blocks"), a.drop("row_blocks", "anchor_blocks")


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Each anchor's first ``n`` other rows of its label: anchor, row, id, score."""
    keys = ["label", "dims"]
    r, a = _dealt(rows, anchors, keys, row_block, anchor_block)
    tile = [*keys, "ab", "rb"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            anchor, row, ids = left.column("row").to_numpy(), right.column("row").to_numpy(), _ids(right)
            score = products(_vectors(left), _vectors(right))
            names = right.column("id").combine_chunks()
            for k in range(len(anchor)):
                others = np.flatnonzero(row != anchor[k])
                at = others[first_of(score[k, others], ids[others], n)]
                for column, values in zip(out, (np.full(len(at), anchor[k]), row[at], at, score[k, at]), strict=True):
                    column.append(values)
        if not out[0]:
            return pa.table([pa.array([], pa.int64())] * 4, names=["anchor", "row", "id", "score"])
        anchor_of, row_of, at, scores = (np.concatenate(c) for c in out)
        return pa.table([pa.array(anchor_of), pa.array(row_of), names.take(pa.array(at)), pa.array(scores)], names=["anchor", "row", "id", "score"])

    found = a.select(*tile, "row", "v").groupBy(*tile).cogroup(r.select(*tile, "row", "id", "v").groupBy(*tile)).applyInArrow(best, FOUND_SCHEMA)
    return _first_rows(found, ["anchor"], n)


def _first_rows(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by score, then id, then row; a rank limit, so each task keeps ``n`` per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def limits(found: DataFrame, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """Per anchor: ``p``, its positives (id, score, upper and lower limit) whose window is not empty, and the slots' ``limits`` from high to low."""
    # floor(highest * score / 100) and ceil(lowest * score / 100), in whole numbers
    upper = F.expr(f"({highest} * score - pmod({highest} * score, 100)) div 100")
    lower = F.expr(f"({lowest} * score + pmod(-{lowest} * score, 100)) div 100")
    p = found.select("anchor", "row", "id", "score", upper.alias("upper"), lower.alias("lower")).where("lower <= upper")
    p = p.groupBy("anchor").agg(F.collect_list(F.struct("row", "id", "score", "upper", "lower")).alias("p"))  # as many as an anchor has positives
    return p.withColumn("limits", F.sort_array(F.array_distinct(F.transform("p", lambda x: x["upper"])), asc=False))


def slot_candidates(rows: DataFrame, anchors: DataFrame, n: int = NEGATIVES, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Each anchor's first ``n`` rows of other labels in each of its slots: anchor, slot, row, id, score.

    ``anchors`` also has the slots' ``limits``, and ``least``, below which no window reaches.
    """
    keys = ["dims"]
    r, a = _dealt(rows, anchors, keys, row_block, anchor_block)
    tile = [*keys, "ab", "rb"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            anchor, ids = left.column("row").to_numpy(), _ids(right)
            labels = pa.concat_arrays([left.column("label").combine_chunks(), right.column("label").combine_chunks()]).dictionary_encode().indices.to_numpy()
            own, other = labels[: len(anchor)], labels[len(anchor) :]
            score = products(_vectors(left), _vectors(right))
            least = left.column("least").to_numpy()
            for k, cuts in enumerate(left.column("limits").to_pylist()):
                high = np.array([*cuts, least[k] - 1], np.int64)
                near = np.flatnonzero((other != own[k]) & (score[k] <= high[0]) & (score[k] > high[-1]))
                s = score[k, near]
                slot = np.searchsorted(-high, -s, side="right") - 1  # the last limit that is not below the score
                for x in np.unique(slot):
                    inside = np.flatnonzero(slot == x)
                    at = inside[first_of(s[inside], ids[near[inside]], n)]
                    for column, values in zip(out, (np.full(len(at), anchor[k]), np.full(len(at), x), near[at], s[at]), strict=True):
                        column.append(values)
        if not out[0]:
            empty = pa.array([], pa.int64())
            return pa.table([empty, pa.array([], pa.int32()), empty, empty, empty], names=["anchor", "slot", "row", "id", "score"])
        anchor_of, slots, at, scores = (np.concatenate(c) for c in out)
        at = pa.array(at)
        return pa.table([pa.array(anchor_of), pa.array(slots, pa.int32()), right.column("row").combine_chunks().take(at), right.column("id").combine_chunks().take(at), pa.array(scores)], names=["anchor", "slot", "row", "id", "score"])

    left = a.select(*tile, "row", "label", "v", "limits", "least").groupBy(*tile)
    found = left.cogroup(r.select(*tile, "row", "id", "label", "v").groupBy(*tile)).applyInArrow(best, SLOT_SCHEMA)
    return _first_rows(found, ["anchor", "slot"], n)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """For each anchor and positive its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition
    on ``id``; ``label`` replaces the label column. Rows that cannot take part
    (``usable``) are left out, zero and empty vectors are not. Rows of
    repeated ids are rows of their own, as anchors, positives and negatives;
    null ids come last among ties. Only vectors of one length are compared.
    Scaled components beyond 2^27 either way count as 2^27. Other columns are
    left out. An anchor without positives or negatives gives no row.
    """
    rows = prepared(vectors, F.col("label") if label is None else label)
    anchors = written(rows.where(is_anchor), "anchors")
    per_anchor = written(limits(positives(rows, anchors, n_positives, row_block, anchor_block), lowest, highest), "positives")
    bounds = per_anchor.select(F.col("anchor").alias("row"), "limits", F.array_min(F.transform("p", lambda x: x["lower"])).alias("least"))
    slots = slot_candidates(rows, anchors.join(bounds, "row"), n_negatives, row_block, anchor_block)
    # an anchor's slots hold at most positives x negatives rows, in the order of their merge
    merged = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), F.col("id").isNull().alias("unnamed"), "id", "row"))).alias("m"))
    each = merged.join(per_anchor, "anchor").select("anchor", "m", F.explode("p").alias("p"), "limits")
    start = F.array_position("limits", F.col("p.upper")) - 1
    window = F.slice(F.filter("m", lambda x: (x["slot"] >= start) & (-x["down"] >= F.col("p.lower"))), 1, n_negatives)
    each = each.select("anchor", "p", F.posexplode(window).alias("k", "negative"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return each.join(named, "anchor").select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("k") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), (-F.col("negative.down")).alias("negative_score"),
    )


def stated(vectors: DataFrame, anchors_every: int = 100, changed_every: int = 7, labels: int = 10) -> DataFrame:
    """The registered query: anchors are ids divisible by ``anchors_every``; labels of ids divisible by ``changed_every`` move on by one."""
    moved = F.when(F.col("vec_id") % changed_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return mine(vectors, F.col("id") % anchors_every == 0, moved)


ORACLE = f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, other) <= {POSITIVES}),
windows AS (
  SELECT p.anchor_id, p.other, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.id NULLS LAST, n.other) AS rank
  FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND {LOWEST} * p.score <= 100 * n.score AND 100 * n.score <= {HIGHEST} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= {NEGATIVES}
"""
