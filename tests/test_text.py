"""Text expressions: splitting, stripping, keywords, subjects."""

import random

from pyspark.sql import functions as F

from tracelens.functions import keywords as kw
from tracelens.functions import lexicon, text

WS_CHARS = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def brute_split(s: str) -> list[str]:
    """Independent character-walk model of the sentence rules."""
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    out, cur, i = [], [], 0
    while i < len(s):
        ch = s[i]
        if ch == "\n":
            out.append("".join(cur))
            cur = []
            i += 1
            continue
        cur.append(ch)
        i += 1
        if ch in ".!?" and i < len(s) and s[i].isspace():
            out.append("".join(cur))
            cur = []
            while i < len(s) and s[i].isspace():
                i += 1
    out.append("".join(cur))
    return [p.strip() for p in out if p.strip()]


def _split(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", text.split_sentences(F.col("t")).alias("s")).collect()
    return {r.i: list(r.s) for r in rows}


def test_split_examples(spark):
    texts = [
        "1. First step.\n2. Second step!  Done?",
        "a\n\n\nb",
        "line one\r\nline two\rline three",
        "No break.Here",
        "Ends with space. Next",
        "",
        None,
    ]
    got = _split(spark, texts)
    assert got[0] == ["1.", "First step.", "2.", "Second step!", "Done?"]
    assert got[1] == ["a", "b"]
    assert got[2] == ["line one", "line two", "line three"]
    assert got[3] == ["No break.Here"]
    assert got[4] == ["Ends with space.", "Next"]
    assert got[5] == [] and got[6] == []


def test_split_matches_brute_force(spark):
    rng = random.Random(7)
    alphabet = list("ab .!?,\n\r\t") + [" ", " ", "\x0b", "\x1c", "　", "​"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = _split(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute_split(t), repr(t)


def test_split_is_idempotent(spark):
    rng = random.Random(11)
    alphabet = list("ab .!?\n") + [" "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    once = _split(spark, texts)
    again = _split(spark, ["\n".join(once[i]) for i in range(len(texts))])
    assert all(again[i] == once[i] for i in range(len(texts)))


def test_strip_is_python_strip(spark):
    vals = ["".join(random.Random(i).choice(WS_CHARS + ["x", "y "]) for _ in range(8)) for i in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(text.strip_ws(F.col("v"))).collect()]
    assert got == [v.strip() for v in vals]


def test_keyword_semantics(spark):
    rows = [
        ("therefore it holds",),  # duplicate entry counts twice
        ("after checking the sum",),  # overlapping entries
        ("it is unlikely",),  # earlier shorter entry wins
        ("the latest result",),  # substring, no word boundary
        ("nothing here",),
    ]
    df = spark.createDataFrame(rows, "s string")
    low = F.lower(F.col("s"))
    out = df.select(
        kw.verification_count(low).alias("n"), kw.hedge_keyword(low).alias("h"), kw.is_verification(low).alias("v")
    ).collect()
    assert [r.n for r in out] == [2, 2, 0, 1, 0]
    assert [r.h for r in out] == [None, None, "likely", None, None]
    assert [r.v for r in out] == [True, True, False, True, False]


def test_lexicon_shape():
    assert len(lexicon.HEDGE_KEYWORDS) == 61
    assert len(lexicon.VERIFICATION_KEYWORDS) == 73
    assert lexicon.VERIFICATION_KEYWORDS.count("therefore") == 2
    assert len(lexicon.FINALITY_CERTAIN) == 19 and len(lexicon.FINALITY_UNCERTAIN) == 15


def test_subjects(spark):
    cases = {
        "Maybe the equation is incorrect.": "the equation",
        "However, I'm not sure about the boundary condition.": "the boundary condition",
        "Let me verify the equation.": "equation",
        "The final answer seems reasonable.": "the final answer",
        "Let me verify the box.": "box",
        "Perhaps check the total.": "total",
        "It is unlikely.": "it",
        "Uncertain about X; really": "x",
        "Verify that 3+4 équals 7": "3+4 équals 7",
        "Done.": "done",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.subj for r in df.select("s", text.extract_subject(F.col("s")).alias("subj")).collect()}
    assert got == cases


def test_keyword_window_subjects(spark):
    from tracelens.operators.score import score_traces

    txt = "Colors, maybe a dash of symbolism. I think the cat sat. Wait, the tax rule was skipped. Perhaps."
    df = spark.createDataFrame([(1, txt)], "id int, text string")
    r = score_traces(df, extractor=text.keyword_window_extractor()).collect()[0]
    subjects = [m["subject"] for m in r["matches"]]
    # content words after the keyword; "wait," is not found as a token (comma)
    # and a keyword with nothing after it: both fall back to the regex subject,
    # which stops at the first comma ("wait")
    assert subjects == ["dash symbolism", "cat sat", "wait", "perhaps"]
