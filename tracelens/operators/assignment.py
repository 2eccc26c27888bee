"""Exclusive greedy assignment over segments of traces.

A trace's hedges take verifications in order: each its best allowed one, which
no later hedge may take unless the two are near-identical. A hedge depends on
all claims before it, so a trace cannot simply be split; but what a stretch of
it does is a function of the claims that enter it. So

1. a trace is cut into segments of ``SEGMENT`` sentences, whatever its length;
2. all segments are folded in parallel, each given the claims that its
   predecessors made in the last round (none at first);
3. segments whose entering claims have changed are folded again, until none has.

The first segment is right in the first round, and by induction the k-th in
the k-th at the latest: where no segment's entering claims change, the claims are
those of the sequential greedy. Claims mostly stay near their hedges, so that
two or three rounds are usual; a chain of hedges that push each other on runs
through a segment within one fold.

A fold sees a bounded number of rows. For each list of :mod:`candidates` that
its hedges have, it is given the members that stand in the segment or were
claimed from it, and of the rest, in order, the first that are still free:
one more than its hedges could claim, at most ``AHEAD``. Those come from a tree
over segments (every node keeps its first members), not from a scan of what
follows. Should a list run out although it could still hold a hedge's
best, the segment's later hedges wait for the next round, in which the claims made so far
are known. A list that cannot beat the best candidate so far (its similarity
with the proximity of the next place after what was given) does not stop the fold.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import lexicon, scoring
from tracelens.operators import candidates, joins, scans

#: Sentences of a segment, and members of a list beyond its end that a fold is given at most.
SEGMENT, AHEAD = 2048, 512
#: Rows that a task of folds gives out at a time, about.
FOLDED_ROWS = 10_000
LINK, INSIDE, BEYOND, FIXED = range(4)


class _List:
    """A list's places in order; those taken are skipped for good."""

    def __init__(self, places: list[int], horizon: float):
        self.places, self.horizon = places, horizon
        self.next = list(range(len(places) + 1))

    def first_free(self, after: int, taken: set[int]) -> int | None:
        i = root = bisect_right(self.places, after)
        while True:
            while self.next[root] != root:
                root = self.next[root]
            if root == len(self.places) or self.places[root] not in taken:
                break
            self.next[root] = root + 1
        while self.next[i] != root and i != root:
            self.next[i], i = root, self.next[i]
        return self.places[root] if root < len(self.places) else None


def fold_segment(rows: Iterable[tuple], threshold: float, decay: float, weights: tuple[float, float], reuse_sim: float, ahead: int = AHEAD) -> list[tuple]:
    """One segment's hedges in order: ``(hidx, hpos, vpos, sim, claims, done)`` (vpos null where nothing is left).

    ``rows`` are ``(kind, hidx, hpos, cls, vpos, sim)``.
    """
    asked: Counter = Counter()
    given: dict[int, set[int]] = {}
    beyond: dict[int, list[int]] = {}
    fixed: dict[int, tuple[int, float]] = {}
    own: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for kind, h, at, c, p, s in rows:
        if kind == LINK:
            asked[c] += 1
            own.setdefault((at, h), []).append((c, s))
        elif kind == FIXED:
            fixed[h] = (p, s)
        else:
            given.setdefault(c, set()).add(p)
            if kind == BEYOND:
                beyond.setdefault(c, []).append(p)
    lists: dict[int, _List] = {}
    for c, places in given.items():
        far = beyond.get(c, ())
        full = len(far) >= min(asked[c] + 1, ahead)
        lists[c] = _List(sorted(places), float(max(far)) if full else math.inf)
    nothing = _List([], math.inf)

    def value(sim: float, gap: float) -> float:
        return weights[0] * sim + weights[1] * math.exp(-gap / decay)

    taken: set[int] = set()
    out, stopped = [], False
    for (at, h), held in sorted(own.items()):
        best = None
        if not stopped:
            if h in fixed:
                p, s = fixed[h]
                best = (value(s, p - at), -p, s)
            open_lists = []
            for c, s in held:
                given_list = lists.get(c, nothing)
                p = given_list.first_free(at, taken)
                if p is None or p > given_list.horizon:
                    if given_list.horizon < math.inf:
                        open_lists.append((s, given_list.horizon + 1))
                    continue
                found = (value(s, p - at), -p, s)
                if best is None or found > best:
                    best = found
            stopped = any(best is None or value(s, max(p, at + 1) - at) >= best[0] for s, p in open_lists)
        if stopped:
            out.append((h, at, None, None, False, False))
        elif best is not None:
            score, p, s = best
            claims = score >= threshold and s <= reuse_sim
            if claims:
                taken.add(-p)
            out.append((h, at, -p, s, claims, True))
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """``((trace_id, seg), rows)`` of each segment, from batches in which its rows follow one another."""
    for key, rows in groupby((r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)), itemgetter(0, 1)):
        yield key, [r[2:] for r in rows]


def _bits_of(number: str, value: int, levels: int):
    """Levels at which the bit of ``number`` is ``value``."""
    return F.expr(f"filter(sequence(0, {levels - 1}), j -> shiftright({number}, j) % 2 = {value})")


def _beyond(uses: DataFrame, keyed: DataFrame, levels: int, ahead: int) -> DataFrame:
    """For each (trace, list, segment) the list's first free members of later segments: ``trace_id, seg, cls, vpos``.

    The segments after one are the union of tree nodes: for each bit of its
    number that is 0, those that agree above it and have 1 there. A member
    counts in the nodes of its segment's bits that are 1.
    """
    nodes = keyed.where("kseg > 0").select("trace_id", "cls", "vpos", "kseg", F.explode(_bits_of("kseg", 1, levels)).alias("j"))
    nodes = nodes.select("trace_id", "cls", "vpos", F.expr("shiftright(kseg, j) * 64L + j").alias("node"))
    first = Window.partitionBy("trace_id", "cls", "node").orderBy("vpos")
    nodes = nodes.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ahead)
    asked = uses.select("trace_id", "cls", "seg", F.least(F.col("asked") + 1, F.lit(ahead)).alias("most"), F.explode(_bits_of("seg", 0, levels)).alias("j"))
    asked = asked.select("trace_id", "cls", "seg", "most", F.expr("(shiftright(seg, j) + 1) * 64L + j").alias("node"))
    met = asked.join(nodes, ["trace_id", "cls", "node"]).where("rank <= most").drop("rank", "node")
    order = Window.partitionBy("trace_id", "cls", "seg").orderBy("vpos")
    return met.withColumn("rank", F.row_number().over(order)).where("rank <= most").select("trace_id", "seg", "cls", "vpos")


def assign(
    hedges: DataFrame,
    vers: DataFrame,
    threshold: float = lexicon.SIMILARITY_THRESHOLD,
    decay: float = lexicon.PROXIMITY_DECAY,
    weights: tuple[float, float] = lexicon.MATCH_WEIGHTS,
    reuse_sim: float = lexicon.REUSE_SIMILARITY,
    subject_sims: DataFrame | None = None,
    segment: int = SEGMENT,
    ahead: int = AHEAD,
) -> DataFrame:
    """Greedy exclusive assignment: ``(trace_id, hidx, hpos, vidx, vpos, sim, prox, score)`` for every hedge with a candidate.

    Trace ids must not be null. ``subject_sims`` as in
    :func:`candidates.hedge_lists`.
    """
    lists, members = candidates.hedge_lists(hedges, vers, subject_sims)
    lists = lists.withColumn("seg", F.expr(f"hpos div {segment}").cast("int"))
    # near-identical subjects ignore claims: their best is fixed
    score = scoring.match_score(F.col("sim"), scoring.proximity_score(F.col("vpos") - F.col("hpos"), decay), weights)
    free = candidates.nearest(lists.where(F.col("sim") > reuse_sim).drop("seg"), members).withColumn("score", score)
    free = free.groupBy("trace_id", "hidx", "hpos").agg(F.max_by(F.struct("vpos", "sim"), F.struct("score", -F.col("vpos"))).alias("b"))
    free = scans.materialize(free.select("trace_id", "hidx", "hpos", "b.*", F.expr(f"hpos div {segment}").cast("int").alias("seg")))
    low = lists.where(F.col("sim") <= reuse_sim)  # every hedge is in the list of all verifications
    uses = scans.materialize(low.groupBy("trace_id", "cls", "seg").agg(F.count(F.lit(1)).alias("asked")))
    segments = uses.select("trace_id", "seg").distinct()
    last = vers.agg(F.max("pos")).first()[0] or 0
    levels = (last // segment).bit_length()
    trace_type = hedges.schema["trace_id"].dataType.simpleString()
    folded_schema = f"trace_id {trace_type}, seg int, hidx int, hpos int, vpos int, sim double, claims boolean, done boolean"
    kinds = {"trace_id": None, "seg": None, "kind": "int", "hidx": "int", "hpos": "int", "cls": "long", "vpos": "int", "sim": "double"}

    def rows_of(df: DataFrame, kind: int) -> DataFrame:
        df = df.withColumn("kind", F.lit(kind))
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    fields = [("seg", pa.int32()), ("hidx", pa.int32()), ("hpos", pa.int32()), ("vpos", pa.int32()), ("sim", pa.float64()), ("claims", pa.bool_()), ("done", pa.bool_())]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # segments are often short: many go into one batch
        out: list[tuple] = []
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("trace_id", first.schema.field("trace_id").type), *fields])

        def to_batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for key, held in _segments(chain([first], batches)):
            out += [(*key, *r) for r in fold_segment(held, threshold, decay, weights, reuse_sim, ahead)]
            if len(out) >= FOLDED_ROWS:
                yield to_batch(out)
                out = []
        if out:
            yield to_batch(out)

    claims = best = active = None  # active segments; None = all
    while True:

        def only(df: DataFrame) -> DataFrame:
            return df if active is None else df.join(active, ["trace_id", "seg"], "left_semi")

        key = F.col("vpos") - 1
        keyed = members
        if claims is not None:
            keyed = keyed.join(claims.select("trace_id", "vpos", "cpos"), ["trace_id", "vpos"], "left")
            key = F.coalesce("cpos", key)
        # a verification is free for a segment that starts at or before its claimer
        keyed = keyed.select("trace_id", "cls", "vpos", F.floor(key / segment).cast("int").alias("kseg"))
        wanted = only(uses)
        inside = wanted.join(keyed.withColumnRenamed("kseg", "seg"), ["trace_id", "cls", "seg"])
        parts = [rows_of(only(low), LINK), rows_of(inside, INSIDE), rows_of(only(free), FIXED)]
        if levels:
            parts.append(rows_of(_beyond(wanted, keyed, levels, ahead), BEYOND))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        folded = rows.repartition("trace_id", "seg").sortWithinPartitions("trace_id", "seg").mapInArrow(fold, folded_schema)
        if best is not None:
            folded = best.join(active, ["trace_id", "seg"], "left_anti").unionByName(folded)
        best = scans.materialize(folded)
        new = scans.materialize(best.where("claims").groupBy("trace_id", "vpos").agg(F.min("hpos").alias("cpos")))
        if not levels:
            break  # every trace is one segment
        before = new.limit(0) if claims is None else claims
        moved = new.join(before.withColumnRenamed("cpos", "old"), ["trace_id", "vpos"], "full").where(~F.col("cpos").eqNullSafe(F.col("old")))
        # segments that start behind the earlier claimer, and not behind the later one or the verification
        until = F.when(F.col("cpos").isNull() | F.col("old").isNull(), F.col("vpos") - 1).otherwise(F.greatest("cpos", "old"))
        moved = moved.select("trace_id", (F.floor(F.least("cpos", "old") / segment) + 1).cast("int").alias("a"), F.floor(until / segment).cast("int").alias("b")).where("a <= b")
        moved = moved.groupBy("trace_id", "a").agg(F.max("b").alias("b")).select("trace_id", F.explode(F.sequence("a", "b")).alias("seg"))
        waiting = best.where("NOT done").select("trace_id", "seg")
        turned = scans.materialize(moved.unionByName(waiting).distinct().join(segments, ["trace_id", "seg"], "left_semi"))
        claims = new
        n, size = joins.measured(turned)
        if not n:
            break
        active = joins.broadcast_if(turned, size)
    named = best.where("vpos IS NOT NULL").join(vers.select("trace_id", "vidx", F.col("pos").alias("vpos")), ["trace_id", "vpos"])
    prox = scoring.proximity_score(F.col("vpos") - F.col("hpos"), decay)
    named = named.select("trace_id", "hidx", "hpos", "vidx", "vpos", "sim", prox.alias("prox"))
    return scans.materialize(named.withColumn("score", scoring.match_score(F.col("sim"), F.col("prox"), weights)))
