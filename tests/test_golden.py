"""Golden traces (FIXTURES.md §2, G1 and G3): numbers derived by reading the rules."""

import pytest

from tracelens.operators.score import score_traces

G1 = """
Maybe the equation is incorrect.
Let me verify the equation.
The equation is correct.

However, I'm not sure about the boundary condition.
The final answer seems reasonable.
"""

CASES = {
    "g1": G1,
    "null": None,
    "blank": "  \n \t ",
    "no_hedge": "The sum is 4. Therefore done.",
    "exclusive": "Maybe the red box is big. Perhaps the blue box is big. Let me verify the box.",
    "reuse": "Maybe the red box is big. Perhaps the box is big. Let me verify the box.",
    "same_sentence": "Perhaps check the total.",
    "dominance_dup": "Maybe therefore the total is fine.",
    "dominance_overlap": "Perhaps let me verify it.",
    "list_order": "It is unlikely.",
    "substring": "The latest page.",
    "short_tail": "Maybe it is fine. Therefore it is.",
    "crlf": "Maybe the equation is wrong.\r\nLet me verify the equation.\rThe end. ",
    "midpoint": "Maybe the cat is big. The dog runs. Perhaps the bird sings. It rains.",
}


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(list(CASES.items()), "name string, text string")
    return {r["name"]: r.asDict(recursive=True) for r in score_traces(df).collect()}


def test_g1_smoke_trace(scored):
    r = scored["g1"]
    assert (r["total_hedges"], r["resolved_hedges"], r["unresolved_hedges"]) == (3, 1, 2)
    assert r["trur"] == 0.3333 and r["weighted_trur"] == 0.2651
    assert r["total_verifications"] == 1 and r["hvr"] == 3.0
    assert r["late_unresolved_ratio"] == 1.0 and r["conclusion_finality"] == -1.0
    assert r["predicted_certainty"] == "Uncertain"
    h1, h2, h3 = r["matches"]
    assert (h1["id"], h1["position"], h1["matched_keyword"], h1["subject"]) == ("H1", 0, "maybe", "the equation")
    assert (h1["matched_verification"], h1["subject_similarity"], h1["match_score"], h1["effective_weight"]) == ("V1", 1.0, 0.9941, 0.2047)
    assert (h2["matched_keyword"], h2["subject"], h2["matched_verification"], h2["match_score"]) == ("not sure", "the boundary condition", None, None)
    assert (h3["matched_keyword"], h3["subject"], h3["effective_weight"]) == ("seems", "the final answer", 1.0)


@pytest.mark.parametrize("name", ["null", "blank"])
def test_blank_text_short_result(scored, name):
    r = scored[name]
    assert (r["total_hedges"], r["resolved_hedges"], r["trur"], r["weighted_trur"], r["matches"]) == (0, 0, 0.0, 0.0, [])
    for k in ("total_verifications", "hvr", "late_unresolved_ratio", "conclusion_finality", "predicted_certainty"):
        assert r[k] is None


def test_no_hedge_is_certain(scored):
    r = scored["no_hedge"]
    assert r["predicted_certainty"] == "Certain" and r["hvr"] == 0.0 and r["conclusion_finality"] == 1.0
    assert r["total_verifications"] == 1


def test_exclusive_claim_bars_second_hedge(scored):
    h1, h2 = scored["exclusive"]["matches"]
    assert (h1["matched_verification"], h1["subject_similarity"], h1["match_score"], h1["effective_weight"]) == ("V1", 0.7071, 0.7832, 0.3734)
    assert h2["resolved"] is False and h2["match_score"] is None and h2["subject_similarity"] is None
    assert scored["exclusive"]["trur"] == 0.5 and scored["exclusive"]["weighted_trur"] == 0.3133


def test_high_similarity_reuse(scored):
    h1, h2 = scored["reuse"]["matches"]
    assert h1["matched_verification"] == h2["matched_verification"] == "V1"
    assert (h2["subject_similarity"], h2["match_score"], h2["effective_weight"]) == (1.0, 0.9941, 0.2047)
    # 1.42190 / 2 = 0.71095 rounds to 0.7109 on the exact binary value (Python semantics)
    assert scored["reuse"]["weighted_trur"] == 0.7109
    assert scored["reuse"]["predicted_certainty"] == "Uncertain"  # fewer than three hedges


def test_same_sentence_never_matches(scored):
    r = scored["same_sentence"]
    assert r["total_hedges"] == 1 and r["total_verifications"] == 1
    (h,) = r["matches"]
    assert h["resolved"] is False and h["match_score"] is None


def test_dominance(scored):
    for name in ("dominance_dup", "dominance_overlap"):
        assert scored[name]["total_hedges"] == 0
        assert scored[name]["total_verifications"] == 1


def test_list_order_and_substring(scored):
    assert scored["list_order"]["matches"][0]["matched_keyword"] == "likely"
    assert scored["substring"]["total_verifications"] == 1


def test_short_tail_finality(scored):
    # two sentences: the finality window covers both (not an empty slice)
    assert scored["short_tail"]["conclusion_finality"] == 1.0


def test_crlf_and_nbsp(scored):
    r = scored["crlf"]
    assert r["total_hedges"] == 1 and r["total_verifications"] == 1
    assert r["matches"][0]["matched_verification"] == "V1"


def test_midpoint_counts_as_late(scored):
    r = scored["midpoint"]
    # 4 sentences, hedges at 0 and 2, no verification: 2 >= 4/2 is late
    assert r["late_unresolved_ratio"] == 0.5


def test_encoder_plugin(spark):
    from tracelens.functions.similarity import hashing_encoder

    df = spark.createDataFrame([("g1", G1)], "name string, text string")
    r = score_traces(df, encoder=hashing_encoder(32)).collect()[0].asDict(recursive=True)
    assert r["total_hedges"] == 3 and r["total_verifications"] == 1
    h1 = r["matches"][0]
    # "the equation" vs "equation": one shared term of two, cosine 1/sqrt(2)
    assert h1["subject_similarity"] == 0.7071 and h1["resolved"] is True


def test_subject_extractor_plugin(spark):
    from pyspark.sql import functions as F

    def last_word(pairs):
        # stand-in for a parser: the sentence's last word, lower-cased
        words = F.split(F.regexp_replace(F.lower("sentence"), r"[^a-z ]", ""), " ")
        return pairs.select("sentence", "keyword", F.element_at(words, -1).alias("subject"))

    df = spark.createDataFrame([("g1", G1)], "name string, text string")
    r = score_traces(df, extractor=last_word).collect()[0].asDict(recursive=True)
    subjects = [m["subject"] for m in r["matches"]]
    assert subjects == ["incorrect", "condition", "reasonable"]
    # "incorrect" vs "equation": no shared term, so H1 can only reach 0.3 * proximity
    assert r["matches"][0]["resolved"] is False and r["matches"][0]["subject_similarity"] == 0.0


def test_lexicon_as_a_parameter(spark):
    """Phrases of the caller's own, with curly apostrophes folded only when asked for."""
    from tracelens.functions.lexicon import Lexicon

    df = spark.createDataFrame([("It\u2019s odd. We looked from above.",), (None,), ("",)], "text string")
    words = {"hedges": ("it's",), "verifications": ("looked from",), "certain": ("above",), "uncertain": ()}
    got = [[r.total_hedges, r.total_verifications, r.conclusion_finality] for r in score_traces(df, words=Lexicon(**words, fold_apostrophes=True)).collect()]
    assert got == [[1, 1, 1.0], [0, None, None], [0, None, None]]
    first = score_traces(df, words=Lexicon(**words, fold_apostrophes=True)).first().matches[0]
    assert (first.sentence, first.matched_keyword) == ("It\u2019s odd.", "it's")
    assert score_traces(df, words=Lexicon(**words)).first().total_hedges == 0
    assert score_traces(df, words=Lexicon(hedges=(), verifications=("a\\'b",))).first().total_hedges == 0


def test_one_subject_per_extraction_step(spark):
    """The words after "about"; the head of the cleaned sentence; its first three words; its first thirty characters."""
    from tracelens.functions.text import extract_subject
    from pyspark.sql import functions as F

    cases = {
        "I'm not sure about the boundary condition.": "the boundary condition",
        "Maybe the equation is incorrect.": "the equation",
        "The final answer seems reasonable.": "the final answer",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.x for r in df.select("s", extract_subject(F.col("s")).alias("x")).collect()} == cases


def test_vector_cosines_are_computed_once_a_pair_of_subjects(spark):
    """A trace of many statements on two subjects keeps four cosines; the scores are those of all pairs."""
    from tracelens.operators import score

    text = " ".join(["Maybe the box is big.", "Perhaps the sum is odd.", "Let me check the box.", "Let me verify the sum."] * 5)
    df = spark.createDataFrame([("t", text), ("blank", " "), ("none", "Done.")], "trace_id string, text string")
    stmts = score.with_statements(df)
    subjects = stmts.selectExpr("explode(concat(_hedges, _vers)) AS s").select("s.subject").distinct()
    names = sorted(r.subject for r in subjects.collect())
    vecs = spark.createDataFrame([(s, [1.0, float(k)]) for k, s in enumerate(names[:-1])], "subject string, vec array<double>")
    found = {r.trace_id: r for r in score.attach_vectors(stmts, vecs).collect()}
    t = found["t"]
    hs, vs = list(dict.fromkeys(h.subject for h in t._hedges)), list(dict.fromkeys(v.subject for v in t._vers))
    assert (len(t._cos), len(t._cos[0])) == (len(hs), len(vs)) and not found["none"]._cos and not found["blank"]._cos

    def cosine(a, b):
        if a == names[-1] or b == names[-1]:
            return 0.0
        x, y = names.index(a), names.index(b)
        return (1 + x * y) / ((1 + x * x) ** 0.5 * (1 + y * y) ** 0.5)

    for h in t._hedges:
        for v in t._vers:
            assert abs(t._cos[h.at][v.at] - cosine(h.subject, v.subject)) < 1e-9


def test_statements_with_vectors_are_stored_and_not_cached(spark, monkeypatch):
    """What is stored holds no sentence but those of hedges; vectors of floats do, and a subject has one at most."""
    from pyspark.sql import functions as F

    from tracelens.operators import scans, score

    def cached(*_):
        raise AssertionError("all rows of a task are cached")

    schemas, stored = [], scans.stored
    monkeypatch.setattr(scans, "materialize", cached)
    monkeypatch.setattr(scans, "stored", lambda df, name: schemas.append(df.schema) or stored(df, name))
    text = "Maybe the box is big. Let me check the box. Perhaps it is odd. Let me verify the sum. Therefore it is so."
    df = spark.createDataFrame([(1, text), (2, None), (3, "Done."), (4, " "), (5, "Nothing.")], "id int, text string")

    def encoder(subjects):
        return subjects.select("subject", F.array(F.length("subject").cast("float"), F.lit(2.0).cast("float")).alias("vec"))

    rows = {r["id"]: r for r in score_traces(df, encoder=encoder).collect()}
    (schema,) = schemas
    assert "_sents" not in schema.names and "sentence" not in schema["_vers"].dataType.elementType.names
    plain = {r["id"]: r for r in score_traces(df).collect()}
    for c in ("total_hedges", "total_verifications", "hvr", "conclusion_finality"):
        assert {k: r[c] for k, r in rows.items()} == {k: r[c] for k, r in plain.items()}
    # "the box" and "therefore it": (7, 2) and (12, 2)
    assert rows[1].matches[0].subject_similarity == 0.9936 and rows[1].matches[0].matched_verification == "V3"
    twice = lambda subjects: encoder(subjects).union(encoder(subjects))
    with pytest.raises(Exception, match="two vectors"):
        score_traces(df, encoder=twice).collect()


def test_extractor_alone_gives_the_subjects(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracelens.functions import text
    from tracelens.operators import score

    def unasked(*_):
        raise AssertionError("the regex extractor was asked, too")

    monkeypatch.setattr(text, "subject_parts", unasked)
    sentences = [f"Maybe item {k} is it." if k % 3 else f"Let me verify that item {k} is it." for k in range(30)]
    df = spark.createDataFrame([(1, " ".join(sentences)), (2, " ".join(sentences[::-1])), (3, ""), (4, None), (5, "Nothing.")], "id int, text string")

    def number(pairs):
        return pairs.withColumn("subject", F.regexp_extract("sentence", r"item (\d+)", 1))

    rows = {r["id"]: r["matches"] for r in score.score_traces(df, extractor=number).collect()}
    assert len(rows[1]) == 20 and rows[3] == rows[4] == rows[5] == []
    assert all(m["subject"] == m["sentence"].split()[2] for k in (1, 2) for m in rows[k])
    twice = lambda pairs: number(pairs).union(number(pairs))
    with pytest.raises(Exception, match="two subjects"):
        score.score_traces(df, extractor=twice).collect()
