"""The stages against brute force, each on its predecessor's documents."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tracelens.llm import langid, packing

from .test_dedup import brute_lines
from .test_whole_job import firsts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_columns_and_counts(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns) and len(after)
    for before, after in stages[1:4]:
        assert (after.n_chars == after.text.str.len()).all()


def test_language_keeps_what_the_model_is_sure_of(spark, stages):
    before, after = stages[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).collect()
    lettered = {i for i, t in zip(before.doc_id, before.text, strict=True) if t and re.search(r"[^\W\d_]", t)}
    assert set(after.doc_id) == {r["doc_id"] for r in found if r["doc_id"] in lettered and r["score"] >= langid.LEAST_SCORE}


def test_lines(stages):
    before, after = stages[1]
    want = brute_lines(list(before[["doc_id", "source", "text"]].itertuples(index=False, name=None)), 0.08, 3, copies_once=True)
    assert Counter(zip(after.doc_id, after.text, strict=True)) == Counter((i, t) for (i, t, _, _), n in want.items() for _ in range(n))


def test_one_of_each_group(stages):
    before, after = stages[2]
    before = before.sort_values("doc_id").reset_index(drop=True)
    assert set(after.doc_id) == {before.doc_id[k] for k in firsts(before.text, 5, 80)} and len(after) < len(before)


def test_personal_data_is_masked(stages):
    before, after = stages[3]
    assert len(before) == len(after) and before.text.str.contains("@mail").any() and not after.text.str.contains("@mail").any()
    clean = before[~before.text.str.contains(r"[0-9@]")]
    assert after.set_index("doc_id").text.loc[clean.doc_id].tolist() == clean.text.tolist()


def test_packing(stages):
    before, after = stages[4]
    assert set(after.doc_id) == set(before.doc_id)
    used = after.groupby("sequence_id").length.sum()
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in used)


def test_stages_of_nulls_and_of_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, host string"
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, None), (1, "", "en", "a", 0, None), (2, "some words of a text here", None, None, 5, "y"), (None, "some words of a text here", "en", "a", None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert pieces.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0 and (pieces.count() > 0) == (docs.count() > 0)


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(out.doc_id, out.start, strict=True)).keys() and out.length.sum() == stages[4][1].length.sum()
