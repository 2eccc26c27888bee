"""SQL functions registered for Spark SQL users."""

from tracelens.functions import sqlfuncs


def test_sql_functions(spark):
    names = sqlfuncs.register_functions(spark)
    assert {"split_sentences", "hedge_keyword", "verification_count", "extract_subject", "proximity_score"} <= set(names)
    r = spark.sql(
        """SELECT split_sentences('One. Two!\\r\\nThree') AS s,
                  hedge_keyword('It is UNLIKELY.') AS hk,
                  verification_count('therefore done') AS vc,
                  is_verification('the latest page') AS iv,
                  extract_subject('However, I''m not sure about the boundary condition.') AS subj,
                  round(proximity_score(1), 6) AS p1,
                  round(proximity_score(gap => 10, decay => 10.0), 6) AS p2,
                  match_score(1.0, 0.5) AS ms,
                  round4(0.71095) AS r4,
                  conclusion_finality(array('Maybe.', 'Therefore yes.')) AS fin,
                  conclusion_finality(array()) AS fin0"""
    ).collect()[0]
    assert list(r.s) == ["One.", "Two!", "Three"]
    assert r.hk == "likely" and r.vc == 3 and r.iv is True  # "therefore" twice + "done"
    assert r.subj == "the boundary condition"
    assert r.p1 == 0.980199 and r.p2 == 0.367879
    assert r.ms == 0.7 * 1.0 + 0.3 * 0.5
    assert r.r4 == 0.7109 and r.fin == 1.0 and r.fin0 == 0.0
