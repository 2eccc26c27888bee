"""Skew-safe scans against brute force, with one hot group spread over partitions."""

import random

from pyspark.sql import functions as F

from tracelens.operators import scans, score, sentence_rows
from tracelens.plans.common import scored, table
from tracelens.sources import planted

from .conftest import SF_SMALL


def test_group_row_number_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.random()) for i in range(3000)] + [(f"g{j}", i, rng.random()) for j in range(40) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    out = scans.group_row_number(df, ["g"], [F.col("x"), F.col("i")], "rn", n=7)
    spread = out.select("g").where(F.col("g") == "hot").count()
    assert spread == 3000
    got = {(r.g, r.i): r.rn for r in out.collect()}
    by = {}
    for g, i, x in rows:
        by.setdefault(g, []).append((x, i))
    for g, items in by.items():
        for rank, (x, i) in enumerate(sorted(items)):
            assert got[(g, i)] == rank


def test_suffix_min_brute_force(spark):
    rng = random.Random(5)
    vals = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", rng.randint(0, 200), rng.randint(0, 1000)) for _ in range(2500)]
    qs = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 6)}", rng.randint(0, 220), k) for k in range(800)]
    v = spark.createDataFrame(vals, "g string, key int, value int")
    q = spark.createDataFrame(qs, "g string, key int, id int").select("g", "key", F.struct("id").alias("qid"))
    got = {r.qid.id: r.answer for r in scans.suffix_min(v, q, ["g"], n=9).collect()}
    for g, key, k in qs:
        cand = [val for gg, kk, val in vals if gg == g and kk >= key]
        assert got[k] == (float(min(cand)) if cand else None)


def test_sentence_rows_equal_one_row_form(spark):
    events = table(spark, SF_SMALL, "events")
    sents = sentence_rows.planted_sentence_rows(spark, events, "user")
    metrics, matches = sentence_rows.score_sentence_rows(sents)
    ref = scored(spark, SF_SMALL, "user").collect()
    got = {r.trace_id: r.asDict() for r in metrics.collect()}
    det = {(r.trace_id, r.id): r.asDict() for r in matches.collect()}
    for r in ref:
        d = r.asDict(recursive=True)
        for k in ("total_hedges", "resolved_hedges", "total_verifications", "hvr", "late_unresolved_ratio", "conclusion_finality", "predicted_certainty", "trur", "weighted_trur"):
            assert got[d["trace_id"]][k] == d[k], (d["trace_id"], k)
        for m in d["matches"]:
            assert {k: det[(d["trace_id"], m["id"])][k] for k in m} == m


def test_hybrid_routes_long_traces(spark):
    s = planted.planted_sentences(spark, table(spark, SF_SMALL, "events")).withColumn("trace_id", planted.trace_id_col("user_day"))
    rows = s.select("trace_id", "ts", "event_id", F.col("sentence").alias("text"))
    mixed = {r.trace_id: r.asDict() for r in sentence_rows.score_row_traces(rows, ["ts", "event_id"], max_rows=3).collect()}
    ref = {r.trace_id: r.asDict() for r in scored(spark, SF_SMALL, "user_day").drop("matches", "user_id", "day").collect()}
    assert mixed.keys() == ref.keys()
    for tid, d in ref.items():
        for k, v in d.items():
            assert mixed[tid][k] == v, (tid, k)


def test_hot_trace_matches_sequential_greedy(spark):
    """A third of all rows in one trace, scored from rows, equals a plain
    sequential greedy computed in numpy."""
    import math
    from collections import Counter

    import numpy as np

    from tracelens.functions import keywords as kw
    from tracelens.functions import similarity, text
    from .conftest import SF_MID

    s = planted.planted_sentences(spark, table(spark, SF_MID, "events"))
    tid = F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string"))
    rows = s.select(tid.alias("trace_id"), "ts", "event_id", F.col("sentence").alias("text"))
    metrics, _ = sentence_rows.score_row_traces_full(rows, ["ts", "event_id"], max_rows=1000)
    hot = metrics.where(F.col("trace_id") == "hot").collect()[0]

    sents = [r.text for r in rows.where(F.col("trace_id") == "hot").orderBy("ts", "event_id").collect()]
    d = spark.createDataFrame([(u,) for u in sorted(set(sents))], "s string")
    low = F.lower("s")
    subj = text.extract_subject(F.col("s"))
    info = {
        r.s: r
        for r in d.select("s", kw.verification_count(low).alias("nv"), kw.hedge_keyword(low).alias("hk"), subj.alias("subj"),
                          similarity.subject_tokens(subj).alias("toks")).collect()
    }
    hedges = [(i, info[x]) for i, x in enumerate(sents) if info[x].hk is not None and info[x].nv < 2]
    vers = [(i, info[x]) for i, x in enumerate(sents) if info[x].nv > 0]

    def cos(a, b):
        ca, cb = Counter(a), Counter(b)
        na, nb = math.sqrt(sum(v * v for v in ca.values())), math.sqrt(sum(v * v for v in cb.values()))
        return 0.0 if na == 0 or nb == 0 else min(max(sum(ca[t] * cb[t] for t in ca) / (na * nb), 0.0), 1.0)

    vpos = np.array([p for p, _ in vers], dtype=float)
    subs = sorted({r.subj for _, r in vers})
    sidx = np.array([subs.index(r.subj) for _, r in vers])
    toks = {r.subj: r.toks for _, r in vers}
    claimed = np.zeros(len(vers), dtype=bool)
    resolved = 0
    for p, r in hedges:
        sim = np.array([cos(r.toks, toks[g]) for g in subs])[sidx]
        ok = (vpos > p) & ~(claimed & (sim <= 0.9))
        if not ok.any():
            continue
        score = np.where(ok, 0.7 * sim + 0.3 * np.exp(-(vpos - p) / 50.0), -1.0)
        j = int(np.argmax(score))
        if score[j] >= 0.6:
            resolved += 1
            claimed[j] = claimed[j] or sim[j] <= 0.9
    assert (hot.total_hedges, hot.total_verifications, hot.resolved_hedges) == (len(hedges), len(vers), resolved)


def test_pairs_hybrid_equals_in_row(spark):
    """Reduced pairs through the long-trace path equal the in-row reduction."""
    rows = sentence_rows.planted_rows(spark, table(spark, SF_SMALL, "events"), "user")
    cols = ["trace_id", "hedge_id", "verification_id", "sim", "score"]
    in_row = sorted(tuple(r) for r in sentence_rows.row_trace_pairs(rows, ["ts", "event_id"]).select(*cols).collect())
    routed = sorted(tuple(r) for r in sentence_rows.row_trace_pairs(rows, ["ts", "event_id"], max_rows=10).select(*cols).collect())
    assert in_row == routed and len(in_row) > 0


def test_vector_hybrid_routes_long_traces(spark):
    """Embedding similarity through the long-trace path equals the in-row form."""
    from tracelens.plans.trace_queries import subject_vector_table

    rows = sentence_rows.planted_rows(spark, table(spark, SF_SMALL, "events"), "user_day")
    _, h, v = sentence_rows.statements_from_rows(rows, ["ts", "event_id"])
    vecs = subject_vector_table(spark, SF_SMALL, h.select("subject").unionByName(v.select("subject")).distinct())
    cols = ["trace_id", "total_hedges", "resolved_hedges", "total_verifications", "hvr", "late_unresolved_ratio",
            "conclusion_finality", "predicted_certainty", "weighted_trur"]
    one_row = {r.trace_id: r for r in sentence_rows.score_row_traces_full(rows, ["ts", "event_id"], subject_vectors=vecs)[0].select(*cols).collect()}
    routed = {r.trace_id: r for r in sentence_rows.score_row_traces_full(rows, ["ts", "event_id"], max_rows=3, subject_vectors=vecs)[0].select(*cols).collect()}
    assert one_row.keys() == routed.keys()
    for tid, a in one_row.items():
        b = routed[tid]
        assert a[:-1] == b[:-1], tid
        assert abs(a.weighted_trur - b.weighted_trur) <= 0.0001


def _cascade(n):
    """Two hedges, then a verification and a hedge in turn: every hedge pushes the next one on."""
    hedge, check = "Maybe the red box is big.", "Let me verify the box."
    return [hedge, hedge] + [check, hedge] * n


def _scored(spark, lines, trace="t"):
    df = spark.createDataFrame([(trace, i, x) for i, x in enumerate(lines)], "trace_id string, ts int, text string")
    metrics, matches = sentence_rows.score_row_traces_full(df, ["ts"], max_rows=1)
    return metrics.collect(), {r.id: r.asDict() for r in matches.collect()}


def test_cascading_claims_equal_the_one_row_fold(spark):
    lines = _cascade(40)
    one = score.score_traces(spark.createDataFrame([("t", "\n".join(lines))], "trace_id string, text string")).collect()[0]
    metrics, matches = _scored(spark, lines)
    assert [m.asDict() for m in one.matches] == [{k: matches[m.id][k] for k in m.asDict()} for m in one.matches]
    assert all(metrics[0][k] == one[k] for k in sentence_rows.METRIC_COLS)


def test_long_cascade_converges(spark):
    n = 3000
    metrics, matches = _scored(spark, _cascade(n))
    # the two first hedges compete for V1; from then on each hedge takes the next free verification
    taken = [matches[f"H{h}"]["matched_verification"] for h in range(1, n + 1)]
    assert taken == [f"V{h}" for h in range(1, n + 1)]
    assert metrics[0].total_hedges == n + 2 and metrics[0].resolved_hedges == n


def test_size_limit_never_changes_the_result(spark):
    events = planted.planted_sentences(spark, table(spark, SF_SMALL, "events")).withColumn("trace_id", planted.trace_id_col("user"))
    rows = events.where("user_id % 5 = 0").select("trace_id", "ts", "event_id", F.col("sentence").alias("text"))
    blank = spark.createDataFrame([("blank", 1, " "), ("blank", 2, ""), ("blank", 3, "\n"), ("blank", 4, None), ("one", 1, ""), ("nulls", 1, None)], "trace_id string, event_id long, text string")
    rows = rows.unionByName(blank.withColumn("ts", F.lit(None).cast(rows.schema["ts"].dataType)))
    results = []
    for limit in (1, 3, sentence_rows.ONE_ROW_LIMIT):
        metrics, matches = sentence_rows.score_row_traces_full(rows, ["ts", "event_id"], max_rows=limit)
        results.append((sorted(map(str, metrics.collect())), sorted(map(str, matches.collect()))))
    assert results[0] == results[1] == results[2]
    assert sum("'blank'" in r or "'one'" in r or "'nulls'" in r for r in results[0][0]) == 3


def _plans(monkeypatch):
    """The physical plans of all that is written by the scans from now on."""
    plans, whole = [], scans.materialize
    monkeypatch.setattr(scans, "materialize", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or whole(df))
    return plans


def test_sentences_are_annotated_behind_the_range_shuffle(spark, monkeypatch):
    """What stands before a range shuffle runs twice, and on the scan's tasks."""
    plans = _plans(monkeypatch)
    texts = ["Maybe the box is big. Let me check the box.", "Done. Therefore the sum is fine.", " "]
    rows = spark.createDataFrame([(f"t{k % 3}", k, texts[k % 7 % 3]) for k in range(60)], "trace_id string, ts int, text string")
    sents, hedges, vers = sentence_rows.statements_from_rows(rows, ["ts"])
    shuffle = plans[0].index("rangepartitioning")
    assert "Generate" in plans[0][:shuffle] and "Generate" not in plans[0][shuffle:]
    want = {}
    for k in range(60):
        want.setdefault(f"t{k % 3}", []).extend([] if not texts[k % 7 % 3].strip() else [x + "." for x in texts[k % 7 % 3].rstrip(".").split(". ")])
    got = {}
    for r in sents.orderBy("trace_id", "pos").collect():
        assert r.pos == len(got.setdefault(r.trace_id, []))
        got[r.trace_id].append(r.sentence)
    assert got == {t: s for t, s in want.items() if s}
    assert hedges.count() == sum(s.startswith("Maybe") for x in want.values() for s in x)


def test_nearest_candidates_come_from_the_scan_alone(spark):
    h = spark.createDataFrame([("a", 1, 0, "red box"), ("a", 2, 3, "sum"), ("b", 1, 5, "sum"), (None, 1, 0, "sum")], "trace_id string, hidx int, pos int, subject string")
    v = spark.createDataFrame([("a", 1, 2, "box"), ("a", 2, 4, "sum"), ("a", 3, 6, "row"), ("b", 1, 5, "sum"), (None, 1, 1, "sum")], "trace_id string, vidx int, pos int, subject string")
    near = sentence_rows.nearest_candidates(h, v)
    assert "qid" not in near.columns and near._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {(r.trace_id, r.hidx): (r.vidx, r.vpos, round(r.sim, 4)) for r in near.collect()}
    assert got == {("a", 1): (1, 2, 0.7071), ("a", 2): (2, 4, 1.0)}
