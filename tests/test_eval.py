"""Suite evaluation: accuracy rules, report parsing, CSV batches, rejects."""

import os
import tempfile

from pyspark.sql import functions as F

from tracelens.functions import lexicon
from tracelens.operators import evaluate as ev
from tracelens.sources import suite


def _results(spark, rows):
    return spark.createDataFrame(rows, "TestCaseID string, ExpectedLabel string, predicted_certainty string")


def test_accuracy_rules(spark):
    rows = [
        ("TC1", "Certain", "Certain"),
        ("TC2", "Certain", "Uncertain"),
        ("TC3", "Resolved Uncertainty", "Certain"),
        ("TC4", "Unresolved Uncertainty", "Certain"),
        ("TC5", "Partially Resolved", "Uncertain"),
        ("TC6", "Partially Resolved", "Certain"),
    ]
    r = _results(spark, rows)
    acc = {x.ExpectedLabel: (x.correct, x.total, x.accuracy) for x in ev.label_accuracy(spark, r).collect()}
    assert acc == {
        "Certain": (1, 2, 0.5),
        "Resolved Uncertainty": (1, 1, 1.0),
        "Unresolved Uncertainty": (0, 1, 0.0),
        "Partially Resolved": (2, 2, 1.0),
    }
    o = ev.overall_accuracy(r).collect()[0]
    assert (o.total_cases, o.counted, o.correct, o.wrong, o.accuracy) == (6, 6, 4, 2, 0.6667)
    miss = sorted(x.TestCaseID for x in ev.misclassified_cases(r).collect())
    assert miss == ["TC2", "TC4"]
    bd = {x.ExpectedLabel: (x.Certain, x.Uncertain) for x in ev.label_breakdown(spark, r).collect()}
    assert bd["Partially Resolved"] == (1, 1) and bd["Unresolved Uncertainty"] == (1, 0)


def test_label_with_no_rows_and_empty_input(spark):
    r = _results(spark, [("TC1", "Certain", "Certain")])
    acc = {x.ExpectedLabel: (x.total, x.accuracy) for x in ev.label_accuracy(spark, r).collect()}
    assert acc["Partially Resolved"] == (0, 0.0) and len(acc) == 4
    empty = _results(spark, [])
    o = ev.overall_accuracy(empty).collect()[0]
    assert o.counted == 0 and o.accuracy is None


def test_parse_report_lines(spark):
    lines = [
        ("TC001       math          High            Certain                 4         2         3    1.33   50.0%    30.1%  Certain          0.0",),
        ("TC002  x  Unresolved Uncertainty  Uncertain  12.0",),
        ("Summary (2 test case(s))",),
        ("TC003 only",),
        ("TC004  Partially Resolved  maybe  1.0",),
    ]
    df = spark.createDataFrame(lines, "value string")
    got = sorted(tuple(r) for r in ev.parse_report_lines(df).collect())
    assert got == [("TC001", "Certain", "Certain"), ("TC002", "Unresolved Uncertainty", "Uncertain")]


def test_csv_batches_round_trip_and_rejects(spark):
    rows = [
        ("TC1", "math", "High", "flat", "Certain", 'Maybe x, "quoted" text.\nSecond line.', "e1", 1),
        ("TC2", "logic", "Low", "rising", "Partially Resolved", "Perhaps y.", "", 2),
        ("", "logic", "Low", "rising", "Certain", "Text.", "e3", 2),
        ("TC4", "logic", "Low", "rising", "Certain", "   ", "e4", 3),
    ]
    cases = spark.createDataFrame(rows, "TestCaseID string, Category string, CertaintyLevel string, ConfidenceTrajectory string, ExpectedLabel string, ReasoningText string, Explanation string, batch int")
    path = os.path.join(tempfile.mkdtemp(prefix="suite-"), "csv")
    suite.write_suite_csv(cases, path)
    back = suite.read_suite_csv(spark, path)
    got = {r.batch: r for r in back.where(F.col("batch") < 2).collect()}
    assert got[1].ReasoningText == 'Maybe x, "quoted" text.\nSecond line.'
    only2 = suite.read_suite_csv(spark, path, [2]).collect()
    assert {r.batch for r in only2} == {2} and {r.Explanation for r in only2} == {"", "e3"}
    valid, rejects = suite.split_rejects(back)
    assert sorted(r.reject_reason for r in rejects.collect()) == ["blank_text", "missing_id"]
    assert sorted(r.TestCaseID for r in valid.collect()) == ["TC1", "TC2"]


def test_breakdown_order(spark):
    rows = [("TC%d" % i, c, lvl, 1, 1, 1, 1.0, 0.5, 0.5) for i, (c, lvl) in enumerate([("a", "Low"), ("b", "High"), ("a", None), ("c", "Medium")])]
    r = spark.createDataFrame(rows, "TestCaseID string, Category string, CertaintyLevel string, total_hedges int, resolved_hedges int, total_verifications int, hvr double, trur double, weighted_trur double")
    out = ev.sort_breakdown(ev.group_breakdown(r, "CertaintyLevel", lexicon.CERTAINTY_LEVEL_ORDER)).collect()
    assert [x.group_key for x in out] == ["High", "Medium", "Low", "Unknown"]
    allg = ev.breakdown_ordered(r).collect()
    assert {x.dimension for x in allg} == {"certainty_level", "category", "total"}
    assert [x.cases for x in allg if x.dimension == "total"] == [4]


def test_unknown_predictions_and_labels_are_not_counted(spark):
    rows = [
        ("TC1", "Certain", "Certain"),
        ("TC2", "Certain", "?"),  # blank trace: not a report line
        ("TC3", "Mystery", "Uncertain"),  # unknown expected label: never correct
    ]
    r = _results(spark, rows)
    o = ev.overall_accuracy(r).collect()[0]
    assert (o.total_cases, o.counted, o.correct, o.wrong, o.accuracy) == (2, 1, 1, 0, 1.0)
    acc = {x.ExpectedLabel: (x.correct, x.total) for x in ev.label_accuracy(spark, r).collect()}
    assert acc["Certain"] == (1, 1)


def test_malformed_csv_record_is_rejected(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="suite-bad-"), "csv", "batch=1")
    os.makedirs(d)
    header = "TestCaseID,Category,CertaintyLevel,ConfidenceTrajectory,ExpectedLabel,ReasoningText,Explanation\n"
    good = 'TC1,math,High,flat,Certain,"Maybe x, y.",e1\n'
    bad = "TC2,math,High,flat,Certain,text,e2,extra,fields\n"
    with open(os.path.join(d, "part-0.csv"), "w", encoding="utf-8") as fh:
        fh.write(header + good + bad)
    cases = suite.read_suite_csv(spark, os.path.dirname(d))
    valid, rejects = suite.split_rejects(cases)
    assert [r.TestCaseID for r in valid.collect()] == ["TC1"]
    assert [(r.TestCaseID, r.reject_reason) for r in rejects.collect()] == [("TC2", "malformed_record")]
