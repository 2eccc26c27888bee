"""Embedding dedup, the n-gram join, components and line dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelens.llm import embedding_dedup, graph, line_dedup, ngram_join

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    out = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(301, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert out == {x: want[x] for x in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=2):
    r = np.random.default_rng(seed)
    out = []
    for label in (1, 2):
        centres = r.normal(size=(12, 16))
        for _ in range(90):
            out.append((label, (centres[r.integers(12)] + 0.28 * r.normal(size=16)).tolist()))
    out += [out[0]] * 30 + [(2, out[0][1]), (None, out[0][1]), (1, None), (1, [0.0] * 16), (1, [float("nan")] + [1.0] * 15), (1, [float("inf")] + [1.0] * 15), (1, [None] + [1.0] * 15), (1, [1.0, 2.0]), (1, [-0.0] + out[0][1][1:]), (1, [1e-30 * x for x in out[5][1]])]
    return [(i if i % 50 else None, label, v) for i, (label, v) in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_dedup(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("node", F.lit("x")).withColumn("n_links", F.lit(5))
    out = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in embedding_dedup.near_duplicates(df, block=block).collect())
    good = [k for k, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for a in good for b in good if a < b and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2])
             and np.dot(rows[a][2], rows[b][2]) / (np.linalg.norm(rows[a][2]) * np.linalg.norm(rows[b][2])) >= 0.93]
    links, root = Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    groups = defaultdict(list)
    for k, x in enumerate(root):
        groups[x].append(k)
    least = {x: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for x, g in groups.items()}
    want = sorted((-1 if i is None else i, links[k], -1 if least[root[k]] is None else least[root[k]], i == least[root[k]]) for k, (i, _, _) in enumerate(rows))
    assert len(pairs) > 400 and out == [(a or -1, b, c or -1, d) for a, b, c, d in want]


def test_quantisation_bounds_hold():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 48)) * r.lognormal(0, 2, size=(300, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantised(unit)
    error = np.abs(unit @ unit.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :])
    assert (error <= e[:, None] + (1 + e)[:, None] * e[None, :]).all()


def test_embedding_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert embedding_dedup.near_duplicates(df).count() == 0


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        out.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    return out


def copies(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A b C d", "É b c d", "é b c d", "x\xa0y a b c", "word " * 5_000, "word " * 5_001]
    passage = [r.choice(words) for _ in range(30)]
    for size in (8, 12, 25, 60, 200):
        for _ in range(4):
            base = [r.choice(words) for _ in range(size)]
            texts += [" ".join(base)] * 2
            for _ in range(8):
                w = list(base)
                for _ in range(r.randint(1, max(1, size // 25))):
                    w[r.randrange(size)] = r.choice(words)
                if r.random() < 0.3:
                    w = w[: r.randint(size * 8 // 10, size)]
                texts.append(" ".join(w))
            texts.append(" ".join(base + passage))
    texts += [" ".join(passage + [r.choice(words) for _ in range(k % 9)]) for k in range(60)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("part", "pair_cost"), [(5_000, 1), (1, 200)])
def test_ngram_join(spark, monkeypatch, part, pair_cost):
    # the second case deals lists to parts and enumerates subsets for many sizes
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "PAIR_COST", pair_cost)
    texts = copies(5)
    rows = [(k * 2 if k % 40 else None, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    sets = word_sets(texts)
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(len(sets), pairs)
    groups = defaultdict(list)
    for k, x in enumerate(root):
        groups[x].append(rows[k][0])
    least = {x: min((i for i in g if i is not None), default=None) for x, g in groups.items()}
    want = Counter((rows[k][0], len(sets[k]), least[x]) for k, x in enumerate(root))
    out = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(df).collect())
    assert len(set(root)) < len(texts) * 0.75 and out == want


def test_subsets_are_chosen_where_lists_are_long():
    sizes = np.array([3, 10, 20, 40, 80, 160])
    assert ngram_join.boundary(sizes[:0], sizes[:0]) == 0
    assert ngram_join.boundary(sizes, 0 * sizes) < ngram_join.boundary(sizes, 0 * sizes + 20) < ngram_join.boundary(sizes, 0 * sizes + 2000) == 160


def test_subsets_are_enumerated_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.xxhash64("text").alias("tk"), "text")
    counts = ngram_join.sketch(docs)
    small = ngram_join.boundary(*ngram_join.sampled(docs, counts, 85), 85)
    keyed = ngram_join.keyed_sets(docs, counts, 85)
    # small sets have more keys than their prefix has elements
    assert small >= 6 and keyed.where(f"n <= {small} AND size(keys) > n - ceil(0.85 * n) + 1").count() > 10


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    r = random.Random(21)
    base = [f"g{k}" for k in range(120)]
    texts = []
    for k in range(200):  # a third of all rows; each pair of them shares most, and each has words of its own
        at = r.randrange(len(base))
        texts.append(" ".join(base[:at] + [f"own{k}", f"more{k}"] + base[at:]))
    texts += [" ".join(f"x{r.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    tested, whole = [], ngram_join.verified

    def counting(pairs, *args):
        tested.append(pairs.count())
        return whole(pairs, *args)

    monkeypatch.setattr(ngram_join, "verified", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {x["doc_id"]: x["component_id"] for x in ngram_join.link_documents(df).collect()}
    assert all(out[k] == 0 for k in range(200)) and all(out[k] == k for k in range(200, 600))
    assert sum(tested) <= 2 * len(texts)


def test_few_edges_are_one_part(spark, monkeypatch):
    r = random.Random(24)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 430)] + [(7, 7)]
    root = roots(430 + 1, [(max(e), min(e)) for e in edges])
    want = {k: root[k] for e in edges if e[0] != e[1] for k in e}
    files, whole = [], graph.written

    def counting(df, name):
        out = whole(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "written", counting)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (100_000, 0):
            monkeypatch.setattr(graph, "ONE_PART", most)
            files.clear()
            assert {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
            assert (max(files[1:]) == 1) == (most > 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_near_copies_in_lists_do_not_multiply_keys(spark):
    r = random.Random(23)
    base, texts = [f"g{k}" for k in range(120)], []
    for k in range(200):
        at = r.randrange(len(base))
        texts.append(" ".join(base[:at] + [f"own{k}", f"more{k}"] + base[at:]))
    texts += [" ".join(f"x{r.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("tk"), "text")
    keyed = ngram_join.keyed_sets(docs, ngram_join.sketch(docs), 85)
    keys, prefixes = keyed.agg(F.sum(F.size("keys")), F.sum(F.expr("n - ceil(0.85 * n) + 1"))).first()
    assert prefixes <= keys <= 1.2 * float(prefixes)


def test_members_of_other_groups_are_counted():
    heads = [np.array(h, np.int64) for h in ([1, 2], [1, 2], [1, 3], [2], [])]
    alone = np.arange(5 * 16, dtype=np.int32).reshape(5, 16)
    assert ngram_join.others_listed(heads, alone).tolist() == [4, 4, 2, 2, 0]
    grouped = alone.copy()
    grouped[1, :8] = grouped[0, :8]
    grouped[2, :7] = grouped[0, :7]  # less than half: not of the group
    assert ngram_join.others_listed(heads, grouped).tolist() == [2, 2, 2, 2, 0]
    assert ngram_join.others_listed([], alone[:0]).tolist() == []


def test_a_group_of_which_some_pairs_link_costs_few_pairs(spark, monkeypatch):
    r = random.Random(22)
    base, texts = [f"g{k}" for k in range(205)], []
    for k in range(400):  # two or three words of each are its own: two and two link, two and three link where they meet
        words = list(base)
        for at in r.sample(range(len(base)), 2 + k % 2):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    tested, whole = [], ngram_join.verified

    def counting(pairs, *args):
        tested.append(pairs.count())
        return whole(pairs, *args)

    monkeypatch.setattr(ngram_join, "verified", counting)
    sets = word_sets(texts)
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(len(sets), links)
    out = {x["doc_id"]: x["component_id"] for x in ngram_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert out == dict(enumerate(root))
    assert len(links) > 25 * len(texts) and sum(tested) <= 5 * len(texts)


def test_texts_are_found_by_shuffle_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST", 0)
    df = spark.createDataFrame(list(enumerate(copies(9)[:80])), "doc_id long, text string")
    out = sorted(map(tuple, ngram_join.link_documents(df).collect()), key=str)
    monkeypatch.undo()
    assert out == sorted(map(tuple, ngram_join.link_documents(df).collect()), key=str)


def test_parity_bits_never_hide_a_link():
    r = np.random.default_rng(6)
    for n in (1, 40, 900, 6000):
        x = r.integers(0, 1 << 62, n).astype(np.uint64)
        for changed in (0, n // 40, n // 8, n):
            y = np.unique(np.concatenate([x[changed:], r.integers(0, 1 << 62, changed).astype(np.uint64)]))
            differ = int(np.bitwise_count((ngram_join.parity(x) ^ ngram_join.parity(y)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(x, y)) and (differ > 0 or changed == 0 or n > 5000 or changed < 3)


def test_one_of_each_group_stays(spark):
    texts = ["a b c d e f g h"] * 3 + ["other words in here too"] + ["", None, " "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, "null id")], "doc_id long, text string")
    left = ngram_join.first_of_each(df)
    assert left.columns == ["doc_id", "text"]
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([0, 3, 4, 5, 6, None])
    assert ngram_join.first_of_each(df.limit(0)).count() == 0


def shingles_of(text):
    return len(ngram_join.shingle_sets(pa.array([text], pa.string()))[0])


def test_shingle_sets():
    assert [shingles_of(t) for t in (None, "", "  ", "a", "a b c", "a b c d", "a a a a a a", "a b c d e")] == [0, 0, 0, 1, 1, 1, 1, 2]


def brute_lines(rows, ratio, min_pages, copies_once=False):
    counted = list({(h, t): (i, h, t) for i, h, t in rows}.values()) if copies_once else rows
    pages, total = defaultdict(set), Counter(h for _, h, _ in counted)
    for k, (_, host, text) in enumerate(counted):
        for line in (text or "").split("\n"):
            if line.strip(" "):
                pages[host, line.strip(" ")].add(k)
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        drop = [x.strip(" ") != "" and len(p := pages[host, x.strip(" ")]) >= min_pages and len(p) > ratio * total[host] for x in lines]
        kept = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
        n = sum(x.strip(" ") != "" for x in lines)
        out.append((i, kept, n, sum(drop)))
    return Counter(out)


@pytest.mark.parametrize("copies_once", [False, True])
def test_line_dedup(spark, copies_once):
    r = random.Random(6)
    rows = []
    for k in range(200):
        host = r.choice(["a", "a", "a", "b", None])
        body = [f"line {r.randint(0, 300)} of some length" for _ in range(r.randint(1, 12))]
        rows.append((k // 2 if k % 9 else None, host, "\n".join(["Menu", *body, " Footer ", ""][r.randint(0, 1) :])))
    rows += [(900, "a", None), (901, "a", ""), (902, "a", "Menu"), (903, "b", "x" * 100_000)] + [(910, "a", "same\npage")] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit(1)).withColumn("drop", F.lit("d")).withColumn("n_lines", F.lit("old"))
    out = line_dedup.drop_boilerplate(df, "doc_id", "source", ratio=0.1, min_pages=5, copies_once=copies_once)
    assert out.columns == ["doc_id", "source", "text", "host", "drop", "n_lines", "n_dropped"]
    got = Counter((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in out.collect())
    assert got == brute_lines(rows, 0.1, 5, copies_once) and sum(x[3] * n for x, n in got.items()) > 100
    emptied = [x for x in got if x[0] == 910]
    assert emptied == [(910, "same\npage", 2, 0) if copies_once else (910, "", 2, 2)]
    assert line_dedup.drop_boilerplate(df.limit(0), "doc_id", "source", copies_once=copies_once).count() == 0


def test_html_text_and_hosts(spark):
    page = "<html><head><style>p{}</style><script>var t='</p>';\nx()</script></head><body><p>One <b>two</b></p><!-- no\n --><ul><li>three</li></ul></body></html>"
    urls = ["http://User@Some.Example.com:80/p?q", "https://x.org", "no url", None]
    df = spark.createDataFrame([(page, u) for u in urls], "html string, url string")
    rows = df.select(line_dedup.text_of_html(F.col("html")).alias("t"), line_dedup.host_of_url(F.col("url")).alias("h")).collect()
    assert [x for x in rows[0]["t"].split("\n") if x.strip()] == ["One two", "three"]
    assert [r["h"] for r in rows] == ["some.example.com", "x.org", None, None]


def test_ngram_sql_on_a_fixture(spark, tmp_path):
    texts = copies(8)[:120]
    rows = [(k, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = Counter(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ngram_join.ORACLE})").fetchall())
    out = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
