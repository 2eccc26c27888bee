"""Language ID, toxicity, quality rules and personal data."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelens.llm import langid, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD_TEXTS = [None, "", " ", "?!", "123", "a", "Ω", "日本語", "x" * 50_000, "word " * 20_000, "\n\n"]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(spark):
    out = queries.op7_language(spark, SF).toPandas().merge(documents(spark).select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(out) == 1000 and out.score.between(0, 1).all() and (held.lang == held.lang_pred).mean() >= 0.99


def test_language_families_and_odd_texts(spark):
    docs = documents(spark).where("lang IS NOT NULL")
    model = langid.fit(docs, per_language=60)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and set(model.pair_machines) == {("de", "en"), ("es", "fr")}
    assert [model.predict(t)[0] for t in ODD_TEXTS[:5]] == ["und"] * 5
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, score string")
    rows = langid.predict(df, model).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(ODD_TEXTS))) and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_of_nothing_learned(spark):
    empty = spark.createDataFrame([(None, "text"), ("en", None), ("en", "12")], "lang string, text string")
    assert langid.fit(empty).predict("some text") == ("und", 0.0)
    one = langid.fit(spark.createDataFrame([("en", "some text")], "lang string, text string"))
    assert one.predict("more")[0] == "en"


def test_toxicity_on_held_out_labels(spark):
    out = queries.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    toxic = held.toxic == 1
    assert out.score.between(0, 1).all()
    assert held.predicted[toxic].mean() >= 0.9 and held.predicted[~toxic].mean() <= 0.02


def test_toxicity_odd_inputs(spark):
    labelled = spark.createDataFrame([("you are an idiot", 1), (None, 1), ("fine words", 0), ("more", None)], "text string, toxic int")
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD_TEXTS + ["what an idiot and a moron"])], "doc_id long, text string, score double")
    model = toxicity.fit(docs, labelled)
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(ODD_TEXTS) + 1 and rows[len(ODD_TEXTS)] > 0.5 and max(rows[i] for i in range(len(ODD_TEXTS))) < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labelled.limit(0))
    assert none.terms == [] and toxicity.score(docs, none).count() == len(rows)


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(1)
    n = 40_000
    y = r.random(n) < 0.15
    votes = np.stack([np.where(y, r.random(n) < p, r.random(n) < q) for p, q in ((0.9, 0.01), (0.8, 0.02), (0.7, 0.01), (0.85, 0.05))], 1)
    votes = np.column_stack([votes, np.where(r.random(n) < 0.7, votes[:, 3], r.random(n) < 0.1)])  # a copy of the fourth voter
    counts = Counter((votes << np.arange(5)).sum(1).tolist())
    model = toxicity.fit_label_model(counts, 5, 0.15)
    assert abs(model.prior - 0.15) < 0.02
    assert model.parents[4] == 3 or model.parents[3] == 4
    assert np.allclose([model.tables[k, 1, 0] for k in range(3) if model.parents[k] < 0], [p for k, p in enumerate((0.9, 0.8, 0.7)) if model.parents[k] < 0], atol=0.05)
    assert model.posterior(0b00111) > 0.95 > 0.05 > model.posterior(0)


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules_and_ratio(spark):
    r = random.Random(2)
    texts = ODD_TEXTS + [" ".join(r.choice(["a", "b", "c", "d%", "e\nf", "é", "x y"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    trusted = spark.createDataFrame([(i,) for i in range(1, 60)] + [(None,), (3,)], "doc_id long")
    ratios = quality.fit(docs, trusted)
    raw, good = np.full(quality.BUCKETS, 1.0), np.full(quality.BUCKETS, 1.0)
    for i, t in enumerate(texts):
        for g in quality.n_grams(t or ""):
            raw[g] += 1
            good[g] += i % 5 != 0 and 1 <= i < 60
    want = np.log(good / good.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratios, want)
    out = Counter((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], round(x["score"], 9)) for x in quality.score(docs, ratios).collect())

    def one(t):
        g = quality.n_grams(t or "")
        return round(float(want[g].mean()) if len(g) else 0.0, 9)

    assert out == Counter((i if i % 5 else None, *plain_rules(t), one(t)) for i, t in enumerate(texts))
    assert not quality.fit(docs, trusted.limit(0)).any()
    assert quality.score(docs.limit(0), ratios).count() == 0


def test_quality_verdicts_follow_the_labels(spark):
    out = queries.op4_quality_rules(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    tested = out[~out.base_failed]
    assert (tested.kept == (tested.quality == 1)).mean() >= 0.99
    assert (out.base_failed == ((out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words))).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and sum((int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9)) for k, c in enumerate(d[::-1])) % 10 == 0],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15],
    }


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(7)
    parts = ["@", "@", ".", "a", "b-c", "9", "255", "256", "1.2.3.4", "+1", " ", "-", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.z", "é", "%", "00012", "٣"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000):
        pii.base_spans(text)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"Some words here. Customer email: user{k}@example.com and so on") for k in range(6)]
    rows += [(k, f"More words. Customer email: id-77{k}-secret is what we have") for k in range(10, 13)]
    rows += [(k, f"we met in the year 200{k % 10} and the number 12345{k} too, call +1 555 123 45{k}") for k in range(20, 60)]
    rows += [(60 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id a@b.cd"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans int").repartition(3)
    out = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(out) == len(rows) - 1
    for k, text in rows:
        assert out[k]["base"] == pii.listed(plain_spans(text or ""))
    for k in range(10, 13):
        start = rows[k - 4][1].index("id-77")
        assert out[k]["spans"] == f"id:{start}:{start + 14}"
    assert all(out[k]["spans"] == out[k]["base"] for k in out if k not in (10, 11, 12))
    masked = {r["doc_id"]: r for r in pii.mask(df).collect()}
    assert masked[11]["text"] == "More words. Customer email: [ID] is what we have" and masked[0]["text"].count("[EMAIL]") == 1 and masked[60]["text"] is None
    assert pii.mask(df).columns == df.columns and pii.mask(df).count() == len(rows)
    assert pii.find(df.limit(0)).count() == 0


@pytest.mark.parametrize(("spans", "want"), [("", "abcdef"), ("email:1:3", "a[EMAIL]def"), ("email:1:3,ip:2:5", "a[EMAIL]f"), ("ip:0:2,id:2:6", "[IP][ID]")])
def test_masked_text(spans, want):
    assert pii.masked_text("abcdef", spans) == want


def test_held_out_uses_crc32(spark):
    import zlib

    out = spark.range(50).select("id", (queries.id_bucket(F.col("id"), 5) == 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)


def plain_graph(texts):
    """Accepted patterns and spans by dictionaries, with the same rules."""
    graph, total = Counter(), Counter()
    seeds = set()
    for text in texts:
        for line in (text or "").split("\n"):
            words = [pii.context_word(w) for w in line.split()]
            for i in range(len(words)):
                total.update(pii.patterns_at(words, i))
        for instance, patterns, seed in pii.mentions(text or "", pii.base_spans(text or "")):
            graph.update((p, instance) for p in patterns)
            seeds |= {instance} if seed else set()
    by = {}
    for p, x in graph:
        by.setdefault(p, []).append(x)
    by = {p: own for p, own in by.items() if len(own) >= pii.MIN_INSTANCES}
    scores, accepted = {x: float(x in seeds) for own in by.values() for x in own}, {}
    while True:
        new = {}
        for p, own in by.items():
            confidence = min(1.0, sum(graph[p, x] * scores[x] for x in own) / total[p])
            if p not in accepted and sum(scores[x] >= 0.5 for x in own) >= pii.MIN_INSTANCES and confidence >= pii.LEAST:
                new[p] = confidence
        if not new:
            return accepted
        accepted |= new
        for x in scores:
            if x not in seeds:
                scores[x] = 1 - float(np.prod([max(1e-9, 1 - accepted.get(p, 0.0)) for p, own in by.items() if x in own]))


def labelled(seed=4):
    import random

    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta sigma omega river stone".split())
    ids = [f"P{k}-{r.randrange(10**6)}" for k in range(40)]
    texts = [f"{word()} {word()}\nEmail: user{k}@example.com\n{word()}" for k in range(14)]
    texts += [f"Email: {x}\n{word()} {word()}" for x in ids[:6]]  # the label begins a line
    texts += [f"{word()} {word()} ref {x} {word()}" for x in ids[:6] for _ in range(2)]  # known identifiers carry a new label
    texts += [f"{word()} ref {x} {word()} {word()}" for x in ids[6:9]]
    texts += [f"{word()} {x} (member) {word()}" for x in ids[:9] for _ in range(2)]  # the label stands behind
    texts += [f"{word()} {x} (member) {word()}" for x in ids[14:18]]
    texts += [f"{word()} {word()} ref unknown-person {word()}", "pin: 12 is what " + word(), f"api key = {'0af9' * 10} {word()}", f"api key = {'1bc8' * 10} {word()}", f"api key = {'77ee' * 11}", "api key = plainword"]
    texts += [f"{word()} {k} {word()} 20{k} {word()}" for k in range(10, 40)]
    return texts, ids


def test_pattern_graph_against_brute_force(spark):
    texts, ids = labelled()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    accepted = pii.accepted_patterns(df, pii.scan(df)).collect()
    want = plain_graph(texts)
    assert {r["pattern"]: round(r["confidence"], 9) for r in accepted} == {p: round(c, 9) for p, c in want.items()}
    assert {"2 ^ email:", "1 ref", "r (member)", "2 key ="} <= set(want)
    out = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    for k, text in enumerate(texts):
        spans = [tuple(map(int, s.split(":")[1:])) for s in out[k].split(",") if s.startswith("id")]
        assert spans == sorted((a, b) for a, b, _ in pii.behind(text, pii.Wanted.of(want)))
    found = {texts[k][int(s.split(":")[1]) : int(s.split(":")[2])] for k in out for s in out[k].split(",") if s.startswith("id")}
    assert set(ids[:9] + ids[14:18]) <= found and {"unknown-person", "plainword", "0af9" * 10} <= found and not {"12", "20", "alpha", "river"} & found


def test_masking_of_repeated_rows_and_of_nothing(spark):
    texts, _ = labelled()
    df = spark.createDataFrame([(1, t, "x") for t in texts] + [(None, None, None), (1, texts[0], "x")], "doc_id long, text string, spans string")
    out = pii.mask(df)
    assert out.columns == df.columns and out.count() == len(texts) + 2 and out.where("text LIKE '%user%'").count() == 0 and out.where("text IS NULL").count() == 1
    assert pii.mask(df.limit(0)).count() == 0
