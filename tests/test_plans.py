"""Physical-plan properties the design relies on."""

from tracelens.plans import registry

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_scan_is_pruned_and_template_broadcast(spark):
    df = registry.queries()["trace_metrics_user_day"](spark, SF_SMALL)
    plan = _plan(df)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "events" in line]
    assert scans and all("value" not in line.split("ReadSchema")[1] for line in scans)  # unused columns pruned
    assert "BroadcastExchange" in plan  # 15-row template side
    assert plan.count("Exchange hashpartitioning") == 1  # trace assembly reuses one shuffle


def test_role_filter_reaches_parquet(spark):
    plan = _plan(registry.queries()["validate_requests"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan or "EqualTo(role,user)" in plan


def test_fold_computed_once_under_filters(spark):
    q = registry.queries()

    def folds(name):
        return q[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")

    # filtering on a metric must not copy the fold into the filter (it did: 86 vs 6)
    assert folds("no_hedge_traces") == folds("trace_metrics_user_day")
    assert folds("misclassified_cases") == folds("trace_metrics_user_day")


def test_broadcast_limit_is_in_bytes(spark):
    from tracelens.operators import joins

    big = spark.range(100).selectExpr("id", "id % 3 AS k")
    small = spark.range(3).selectExpr("id AS k", "repeat('x', 1000) AS wide")
    rows, size = joins.measured(small)
    assert rows == 3 and 3_000 < size < 3_200
    assert joins.measured(small.where("k < 0")) == (0, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(joins.join_checked(big, small, "k", limit=size))
        over = joins.join_checked(big, small, "k", limit=size - 1)
        assert "BroadcastHashJoin" not in _plan(over) and over.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
