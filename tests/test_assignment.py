"""Candidate lists and the segment fold against a sequential greedy over all pairs."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelens.operators import assignment, candidates, scans, sentence_rows

WORDS = ["red", "box", "sum", "total", "value", "input", "result", "case", "row", "table", "edge", "node"]


def toks(subject):
    return [t for t in subject.lower().split() if t not in ("the", "a", "an")]


def cosine(a, b):
    a, b = Counter(toks(a)), Counter(toks(b))
    if not a or not b:
        return 0.0
    dot = sum(a[t] * b[t] for t in a)
    return min(max(dot / (math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))), 0.0), 1.0)


def greedy(lines, exclusive=True):
    """{hidx: (vidx, vpos, sim, score)} of one trace; lines are (kind, subject), kind h, v or anything else."""
    vers = [(p, s) for p, (k, s) in enumerate(lines) if k == "v"]
    out, claimed = {}, set()
    for h, (p, s) in enumerate([(p, s) for p, (k, s) in enumerate(lines) if k == "h"]):
        best = None
        for j, (q, t) in enumerate(vers):
            sim = cosine(s, t)
            if q > p and not (exclusive and j in claimed and sim <= 0.9):
                score = 0.7 * sim + 0.3 * math.exp(-(q - p) / 50)
                if best is None or score > best[3] + 1e-12:
                    best = (j, q, sim, score)
        if best:
            out[h] = best
            if best[3] >= 0.6 and best[2] <= 0.9:
                claimed.add(best[0])
    return out


def frames(spark, traces):
    hs, vs = [], []
    for t, lines in traces.items():
        for kind, rows in (("h", hs), ("v", vs)):
            for i, (p, s) in enumerate([(p, s) for p, (k, s) in enumerate(lines) if k == kind]):
                rows.append((t, i, p, s))
    make = lambda rows, name: spark.createDataFrame(rows, f"trace_id string, {name} int, pos int, subject string").repartition(5)
    return make(hs, "hidx"), make(vs, "vidx")


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.trace_id, {})[r.hidx] = (r.vidx, r.vpos, round(r.sim, 9), round(r.score, 9))
    return out


def want(traces, exclusive=True):
    out = {t: {h: (j, q, round(s, 9), round(x, 9)) for h, (j, q, s, x) in greedy(lines, exclusive).items()} for t, lines in traces.items()}
    return {t: x for t, x in out.items() if x}


def mixed(seed, n, subject_words=(1, 4), words=WORDS):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(*subject_words)))
    return [(r.choice("hhvx"), r.choice([text(), "the", ""]) if r.random() < 0.05 else text()) for _ in range(n)]


TRACES = {
    "short": mixed(1, 30),
    "long": mixed(2, 400),
    "few subjects": mixed(3, 300, (1, 1), WORDS[:3]),
    "many words": mixed(4, 150, (5, 9), WORDS + [f"w{k}" for k in range(60)]),
    "hedges first": [("h", "red box")] * 120 + [("v", "box")] * 100 + [("v", "red thing")] * 40,
    "cascade": [("h", "red box")] * 2 + [("v", "box"), ("h", "red box")] * 100,
    "no verification": [("h", "red box")] * 5,
    "no hedge": [("v", "red box")] * 5,
    "one word in all": [("h" if k % 2 else "v", f"box n{k % 37} m{k % 11}") for k in range(240)],
}


@pytest.mark.parametrize("segment,ahead,size", [(2048, 512, 400), (32, 8, 150), (8, 1, 40)])
def test_segments_give_the_sequential_greedy(spark, segment, ahead, size):
    traces = {t: lines[-size:] for t, lines in TRACES.items()}
    hedges, vers = frames(spark, traces)
    assert got(assignment.assign(hedges, vers, segment=segment, ahead=ahead)) == want(traces)


@pytest.mark.parametrize("rare,class_terms", [(candidates.RARE, candidates.CLASS_TERMS), (0, 6), (2, 2), (0, 0)])
def test_nearest_of_lists_holds_the_best(spark, monkeypatch, rare, class_terms):
    whole = candidates.subject_links
    monkeypatch.setattr(candidates, "subject_links", lambda h, v: whole(h, v, rare, class_terms))
    hedges, vers = frames(spark, TRACES)
    assert got(sentence_rows.independent_best(hedges, vers)) == want(TRACES, exclusive=False)


def test_list_similarities_are_lower_bounds_and_rows_stay_few(spark):
    n = 1500
    lines = [("h" if k % 2 else "v", f"box n{k}") for k in range(n)]
    hedges, vers = frames(spark, {"t": lines, "u": TRACES["one word in all"]})
    links, members = candidates.subject_links(hedges, vers)
    rows = links.join(members, ["trace_id", "cls"]).select("hsubject", "subject", "sim").limit(5000).collect()
    assert all(r.sim <= cosine(r.hsubject, r.subject) + 1e-9 for r in rows)
    # every hedge shares `box` with all 750 subjects, and meets them in one class
    lists, held = candidates.hedge_lists(*frames(spark, {"t": lines}))
    assert lists.count() == n and held.count() == n


def test_fold_meets_a_bounded_number_of_rows(spark, monkeypatch):
    """A cascade of many segments: no fold is given more than a fixed number of rows."""
    n, segment = 220, 64
    lines = [("h", "red box")] * 2 + [("v", "box"), ("h", "red box")] * n
    seen = spark.sparkContext.accumulator(0, _Largest())
    whole = assignment.fold_segment

    def counted(rows, *args):
        seen.add(len(rows))
        return whole(rows, *args)

    monkeypatch.setattr(assignment, "fold_segment", counted)
    hedges, vers = frames(spark, {"t": lines, "other": TRACES["long"]})
    out = got(assignment.assign(hedges, vers, segment=segment, ahead=32))
    assert out == want({"t": lines, "other": TRACES["long"]})
    assert 0 < seen.value <= 20 * segment


class _Largest:
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def test_rows_of_a_null_trace_are_one_trace_of_any_length(spark):
    hedge, check = "Maybe the red box is big.", "Let me verify the box."
    rows = [("a", k, [hedge, check, "Then."][k % 3]) for k in range(30)] + [(None, k, [hedge, check][k % 2]) for k in range(200)]
    df = spark.createDataFrame(rows, "trace_id string, ts int, text string").repartition(6)
    for limit in (10, 4000):
        metrics, matches = sentence_rows.score_row_traces_full(df, ["ts"], max_rows=limit)
        out = {r.trace_id: r for r in metrics.collect()}
        assert set(out) == {"a", None} and out[None].total_hedges == 100 and out[None].total_verifications == 100
        assert Counter(r.trace_id for r in matches.collect()) == {"a": 10, None: 100}
        pairs = sentence_rows.row_trace_pairs(df, ["ts"], max_rows=limit)
        assert {r.trace_id for r in pairs.select("trace_id").distinct().collect()} == {"a", None}
    cold, hot, _, unnamed = sentence_rows.split_by_size(df.select("trace_id", "ts", F.col("text").alias("_text")), 10)
    assert cold.where("trace_id IS NULL").count() == 0 and hot.where("trace_id IS NULL").count() == 0 and unnamed.count() == 200


def test_segments_of_several_batches_are_folded_whole():
    """One Python call folds many short segments, also those that a batch ends in."""
    rows = [("a", 0, k) for k in range(3)] + [("a", 1, 9)] + [("b", 1, k) for k in range(4)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("trace_id", "seg", "x"), r, strict=True)) for r in rows[i : i + 2]]) for i in range(0, len(rows), 2)]
    found = list(assignment._segments(iter(batches)))
    assert found == [(("a", 0), [(0,), (1,), (2,)]), (("a", 1), [(9,)]), (("b", 1), [(0,), (1,), (2,), (3,)])]


def test_short_traces_are_not_folded_one_python_call_each(spark, monkeypatch):
    plans = []
    whole = scans.materialize
    monkeypatch.setattr(scans, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    traces = {f"t{k}": [("h", "red box"), ("v", "box"), ("v", f"red box {k}")] for k in range(300)}
    hedges, vers = frames(spark, traces)
    assert got(assignment.assign(hedges, vers)) == want(traces)
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroups" in p for p in plans)
