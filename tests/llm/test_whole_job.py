"""Places where an operator once did less than the whole job."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tracelens.llm import ngram_join, quality

from .test_dedup import ASCII_LOWER, copies, roots


def runs_of_words(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def firsts(texts, n, percent):
    sets = [runs_of_words(t, n) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k for k, x in enumerate(roots(len(sets), pairs)) if k == x}


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    texts = copies(9)
    r = random.Random(10)
    for _ in range(12):  # one word of sixty changed in the middle: 0.84 at five words, 0.87 at four; two: less than 0.8
        base = [f"v{r.randrange(10_000)}" for _ in range(60)]
        for k in range(3):
            texts.append(" ".join(base[:20] + [f"new{k}"] * (k > 0) + base[20 + (k > 0) :]))
            texts.append(" ".join(base[: 48 + 2 * k]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = [x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    want = firsts(texts, 5, 80)
    assert want != firsts(texts, 4, 85) and len(out) == len(want) and set(out) == want


WORDS = {
    "en": "the weather was fine and people walked along the river talking about their work and home",
    "de": "das wetter war schön und die leute gingen am ufer entlang und sprachen über ihre arbeit",
    "fr": "le temps était beau et les gens marchaient le long de la rivière en parlant de leur travail",
    "es": "hacía buen tiempo y la gente caminaba junto al río hablando de su trabajo y de sus hijos",
}


def test_language_stage_rejects_what_was_not_learned(spark):
    r = random.Random(3)
    clean = [(lang, " ".join(r.choice(words) for _ in range(40))) for lang, line in WORDS.items() for words in [line.split()] for _ in range(30)]
    strange = ["日本語の文章です。これは長いです。" * 5, "Это русский текст о погоде и людях. " * 5, "xqzj kkfw pqzx wvvq zzkj qxwp " * 10]
    rows = [(k, t, lang) for k, (lang, t) in enumerate(clean)] + [(1000 + k, t, None) for k, t in enumerate([*strange, "12 34", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x["doc_id"] for x in corpus_pipeline.languages(spark, df, "").collect()} == set(range(len(clean)))


def test_language_stage_keeps_letters_when_nothing_was_learned(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "日本語", None), (3, "12", None), (4, None, None)], "doc_id long, text string, lang string")
    assert {x["doc_id"] for x in corpus_pipeline.languages(spark, df, "").collect()} == {1, 2}


def test_one_row_of_each_group_stays(spark):
    a, b, c = "a b c d e f g h", "other words in here too", "a third text of its own"
    rows = [(1, a), (1, b), (2, a), (2, c), (None, a), (None, c), (None, "without a name"), (None, "without a name"), (None, ""), (None, None)]
    left = ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x["doc_id"], x["text"]) for x in left) == Counter([(1, a), (1, b), (2, c), (None, "without a name"), (None, ""), (None, None)])


@pytest.mark.parametrize("broadcast_ids", [200_000, 0])
def test_every_trusted_document_counts(spark, monkeypatch, broadcast_ids):
    monkeypatch.setattr(quality, "BROADCAST_IDS", broadcast_ids)
    r = random.Random(4)
    texts = ["".join(r.choice("abcdef ") for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    raw, good = np.full(quality.BUCKETS, 1.0), np.full(quality.BUCKETS, 1.0)
    for i, t in enumerate(texts):
        np.add.at(raw, quality.n_grams(t), 1)
        np.add.at(good, quality.n_grams(t), i % 3 != 0 and i < 200)
    ratios = quality.fit(docs, spark.range(-60_000, 200).withColumnRenamed("id", "doc_id"))
    assert np.allclose(ratios, np.log(good / good.sum()) - np.log(raw / raw.sum()))


def test_line_stage_drops_boilerplate_that_is_most_of_a_text(spark):
    menu = "home and news and sport and contact and imprint"
    rows = [(k, "s", f"{menu}\na long line of its own that says {k} and goes on for a while") for k in range(20)]
    rows += [(30, "s", f"{menu}\nthin"), (31, "s", menu)] + [(40 + k, "s", "a copied page\nof two lines") for k in range(6)]
    out = {x["doc_id"]: x["text"] for x in corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"), "").collect()}
    assert out == {i: t.removeprefix(menu).removeprefix("\n") for i, _, t in rows}
