"""URL verdicts, hard negatives and ranked search against brute force."""

import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelens.llm import hard_negatives, lexical_search, queries, url_filter

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracles import digest  # noqa: E402


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, rows)[1] == digest(columns, rel.fetchall())[1]
    return rows


def ruled(url, rules=url_filter.RULES):
    """(host, path, rule, verdict) by plain Python."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, None)


def propagated(edges, seeds):
    """The same whole-number PageRank over dictionaries."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    start = {h: w * 15 // 100 for h, w in seeds.items()}
    now = dict(start)
    for _ in range(url_filter.ROUNDS):
        new = Counter(start)
        for h, s in now.items():
            for b in out[h]:
                new[b] += s // 20 * 17 // len(out[h])
        now = {h: s for h, s in new.items() if s > 0}
    return now


URLS = [
    "http://Shop.Example.COM/en/x?q#f", "https://shop.example.com/de/", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://news.net/es/1", "http://news.net/en/1", "http://news.net", "http://news.net?x=/es/",
    "http://blog.news.net/en/", "http://far.org/", "ftp://a.b://c/d", "http://", "no url", "", None, "http://examplecom/en/", "http://com/x", "http://xn--é.net/fr/é", "http://linked.org/a", "http://good.org/", "http://user@host.net:80/es/",
    "http://bad.net/es/1", "http://bad.net/fr/2", "http://bad.net/es/3", "http://bad.net/en/",
]
LINKS = {
    "http://far.org/": '<a class="x" href="http://news.net/es/1">1</a><A HREF=//Linked.org>2</a><a href="/es/">3</a><a href="#">',
    "http://linked.org/a": "<a\nhref='https://news.net'>x</a><a data-href='http://no.org/'>",
    "https://shop.example.com/de/": '<a href="http://good.org/x">',
    "http://good.org/": None,
}


def pages(spark):
    rows = [(k if k % 5 else None, u, LINKS.get(u, "<p>text</p>"), "x", 1) for k, u in enumerate(URLS + URLS[:6])]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict int")


def test_url_verdicts_against_brute_force(spark):
    rows = pages(spark).select("page_id", "url", "html").collect()
    found = url_filter.judge(pages(spark)).collect()
    host = [ruled(r["url"]) for r in rows]
    assert Counter((r["page_id"], *h[:3]) for r, h in zip(rows, host, strict=True)) == Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in found)
    edges = set()
    for r, h in zip(rows, host, strict=True):
        to = [t.lower() for t in re.findall(url_filter.LINK, r["html"] or "")] if h[0] else []
        edges |= {(h[0], t) for t in to}
        for x in [h[0], *to]:
            while x.count(".") > 1:
                edges |= {(x, x.split(".", 1)[1]), (x.split(".", 1)[1], x)}
                x = x.split(".", 1)[1]
    edges = {(a, b) for a, b in edges if a != b}
    n = Counter(h[0] for h in host if h[0])
    weights = {v: {k: url_filter.WEIGHT * c // n[k] for k, c in Counter(h[0] for h in host if h[3] == v).items()} for v in ("allow", "block")}
    trust, distrust = propagated(edges, weights["allow"]), propagated({(b, a) for a, b in edges}, weights["block"])
    assert {r["host"]: (r["trust"], r["distrust"]) for r in found} == {h[0]: (trust.get(h[0], 0), distrust.get(h[0], 0)) for h in host}
    assert trust["good.org"] > 0 and min(distrust["linked.org"], distrust["far.org"]) > 0 and not {"good.org", "no.org"} & set(distrust)
    for r in found:
        own = ruled(r["host"] and f"http://{r['host']}{r['path']}")[3]
        assert r["verdict"] == (own or ("block" if r["distrust"] >= url_filter.LEAST and r["distrust"] > r["trust"] else "allow"))
    assert {r["verdict"] for r in found if r["rule"] is None} == {"allow", "block"}


def test_url_verdicts_equal_their_sql(spark):
    same_as_sql(url_filter.judge(pages(spark)), url_filter.ORACLE, pages=pages(spark).select("page_id", "url", "html"))


def test_url_verdicts_with_other_rules_and_without(spark):
    rules = [("net", "/", "allow"), ("net", "/e", "block"), ("net", "/es", "allow"), ("news.net", "", "block"), ("NEWS.net", "/en/1", "allow"), (None, "/", "block"), ("org", None, "block")]
    out = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.judge(pages(spark), rules).collect()}
    assert out["news.net", "/es/1"] == ("news.net", "block") and out["news.net", "/en/1"] == ("news.net/en/1", "allow") and out["user@host.net:80", "/es/"][0] is None
    assert out["blog.news.net", "/en/"][0] == "news.net" and out["far.org", "/"][0] is None
    assert {r["verdict"] for r in url_filter.judge(pages(spark), []).collect()} == {"allow"}
    assert url_filter.judge(pages(spark).limit(0)).count() == 0


def test_trust_of_a_hub_is_divided(spark):
    edges = spark.createDataFrame([("hub", f"h{k}") for k in range(50)] + [("h0", "hub")], "src string, dst string")
    seeds = spark.createDataFrame([("hub", "trust", 1_000_000_000), ("h7", "distrust", 1_000_000_000)], "host string, kind string, weight long")
    out = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagated(edges, seeds).collect()}
    assert out["h0"][0] == out["h49"][0] > 0 and out["hub"][0] > 150_000_000
    assert out["h7"][1] == 150_000_000 and out["hub"][1] > out["h0"][1] > 0 and out.get("h1", (0, 0))[1] == 0


def vectors(seed=5, n=420):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 6)) * 0.4
    rows = [(k, (centres[k % 4] + 0.3 * r.normal(size=6)).tolist(), int(k % 4)) for k in range(n)]
    rows += [rows[0], rows[100], (200, rows[1][1], 1), (None, rows[2][1], 2), (None, rows[3][1], 3), (300, None, 1), (301, rows[4][1], None), (302, [None] * 6, 1), (303, [float("nan")] + [1.0] * 5, 1), (304, [float("inf")] + [1.0] * 5, 1)]
    rows += [(500, [0.0] * 6, 2), (600, [], 1), (700, [1.0, 2.0], 3), (701, [1.5, 2.0], 4), (800, [-x for x in rows[7][1]], 3)]
    return rows


def mined(rows, positives=5, negatives=10):
    own = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((k, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = 1 << 62
    out = Counter()
    for a in own:
        if a[1] is None or a[1] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), last if b[1] is None else b[1], b[0], b[3]) for b in own if b[0] != a[0] and len(b[2]) == len(a[2]))
        for s, i, _, _ in [x for x in scored if x[3] == a[3]][:positives]:
            inside = [x for x in scored if x[3] != a[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            for rank, x in enumerate(inside, 1):
                out[a[1], None if i == last else i, rank, None if x[1] == last else x[1], -s, -x[0]] += 1
    return out


@pytest.mark.parametrize("row_block,anchor_block", [(16_384, 4_096), (50, 2)])
def test_hard_negatives_against_brute_force(spark, row_block, anchor_block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(3)).withColumn("row", F.lit("x")).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(df, F.col("id") % 100 == 0, label, row_block=row_block, anchor_block=anchor_block)
    out = Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())
    assert out == mined(rows) and len(out) > 100


def test_hard_negatives_equal_their_sql(spark):
    df = spark.createDataFrame([r for r in vectors() if r[0] not in (600,)], "vec_id long, embedding array<float>, label int")
    same_as_sql(hard_negatives.stated(df), hard_negatives.ORACLE, embeddings=df)


def test_hard_negatives_of_large_numbers_ties_and_nothing(spark):
    schema = "vec_id long, embedding array<double>, label int"
    big = [(k, [1e30 if k % 2 else 3e5, -2e5 + k], k % 3) for k in range(0, 400, 20)]
    out = hard_negatives.mine(spark.createDataFrame(big, schema), F.col("id") % 100 == 0).collect()
    for r in out:
        a, p, n = (np.array([math.floor(max(-(2.0**27), min(2.0**27, 256 * x))) for x in dict((i, v) for i, v, _ in big)[i]], dtype=object) for i in (r["anchor_id"], r["positive_id"], r["negative_id"]))
        assert (r["positive_score"], r["negative_score"]) == (int(a @ p), int(a @ n))
    same = [(k, [1.0, 1.0] if k % 2 else [1.0, 0.5], k % 2) for k in range(60)]
    moved = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    out = hard_negatives.mine(spark.createDataFrame(same * 2, schema), F.col("id") == 0, moved, row_block=16, anchor_block=1).collect()
    assert Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out) == mined(same * 2)
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("id") == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], schema), F.col("id") == 0).count() == 0


def test_slots_keep_what_overlapping_windows_need():
    score, ids = np.array([5, 9, 9, 3, 9, 7]), np.array([1, 8, 2, 3, 4, 5])
    assert ids[hard_negatives.first_of(score, ids, 2)].tolist() == [2, 4] and ids[hard_negatives.first_of(score, ids, 9)].tolist() == [2, 4, 8, 5, 1, 3]
    x = np.array([[1 << 27, -(1 << 27)]], np.int32)
    assert hard_negatives.products(x, x)[0, 0] == 2 * (1 << 54)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, top=20):
    bags = [Counter(terms(t)) for _, t in docs]
    n, total = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = Counter()
    for item, text in items:
        scored = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            m = 75 + 25 * sum(bag.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        for rank, (s, none, doc) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, None if none else doc, -s] += 1
    return out


def corpus(seed=11):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["été", "ÉTÉ", "日本", "straße", "x1", "42"]

    def text(n):
        return " ".join(r.choice((str.upper, str, str))(words[min(len(words) - 1, int(r.expovariate(0.02)))]) + r.choice(["", ".", ",", "\n", "--", "'s"]) for _ in range(n))

    docs = [(k, text(r.choice((1, 3, 20, 60, 200)))) for k in range(260)]
    docs += [(260, None), (261, ""), (262, " .,\x00\x7f "), (263, text(4000)), (None, text(80)), (5, text(90)), (5, docs[5][1]), (None, docs[6][1])] + [(400 + k, docs[9][1]) for k in range(70)]
    items = [(k, text(r.choice((1, 5, 40)))) for k in range(12)] + [(50, docs[9][1]), (51, None), (52, "..."), (53, "unseen terms only"), (None, "w1 w1 w1 W2"), (3, text(6)), (54, docs[263][1])]
    return docs, items


@pytest.mark.parametrize("query_bytes", [4 << 20, 3000])
def test_ranked_search_against_brute_force(spark, query_bytes):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("tk", F.lit("x")).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("part", F.lit(9))
    out = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical_search.search(d, i, query_bytes=query_bytes).collect())
    assert out == ranking(docs, items)


def test_ranked_search_equals_its_sql(spark):
    docs, items = corpus(12)
    docs = [x for x in docs if x[0] != 5 or x is docs[5]]  # SQL leaves ties of one doc_id open
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    same_as_sql(lexical_search.search(d, i), lexical_search.ORACLE, documents=d, benchmark=i)


def test_ranked_search_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical_search.search(d.limit(0), i).count() == 0 and lexical_search.search(d, i.limit(0)).count() == 0
    assert lexical_search.search(d.where("text IS NULL"), i).count() == 0
    assert [tuple(r) for r in lexical_search.search(d, i).collect()] == [tuple(x) for x in ranking([(1, "a b"), (2, None)], [(1, "a"), (2, None)])]


def test_bounds_are_never_below_scores_and_near_them(spark):
    docs, items = corpus(13)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tk", F.xxhash64("text"))
    q = lexical_search.read_queries([x for x in items if x[1]])
    lexical_search.counted(rows, q)
    index = lexical_search.build_index(rows).collect()
    bounds = {}
    for b in index:
        got = lexical_search.block_bounds(b["bits"], np.array(b["n"], np.int64), bytes(b["slices"]), lexical_search.term_hashes(q.terms), q)
        for k, key in enumerate(zip(b["doc_id"], b["tk"], strict=True)):
            bounds[key] = got[:, k]
    everything = spark.createDataFrame([(i, d, t) for d, t in bounds for i in range(len(q.ids))], "item int, doc_id long, tk long")
    exact = lexical_search.exact_scores(rows, everything, q).collect()
    assert len(exact) > 1000 and all(bounds[r["doc_id"], r["tk"]][r["item"]] >= r["score"] for r in exact)
    assert np.median([bounds[r["doc_id"], r["tk"]][r["item"]] / r["score"] for r in exact]) < 1.1


def test_term_codes_are_the_terms():
    docs, _ = corpus(14)
    texts = pa.array([None, *[t for _, t in docs], "", "éa-b", "\x85x\xa0y z"], pa.string())
    for part in (texts, texts.slice(3, 40), texts.slice(len(texts) - 2)):
        names, codes = lexical_search.term_codes(part)
        assert [[names[int(c)].as_py() for c in own] for own in codes] == [terms(t) for t in part.to_pylist()]


def test_queries_are_registered():
    assert {"op11_url_filter", "op12_hard_negatives", "op13_ranked_search"} <= set(queries.QUERIES) & set(queries.ORACLES)
