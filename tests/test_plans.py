"""Plan shapes that matter at scale."""

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["null_rates", "endpoint_metrics_daily", "class_metrics", "feature_drift", "data_gate"])
def test_one_scan_of_the_source(spark, name):
    assert plan(spark, name).count("FileScan") == 1


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan(spark, "canary_gate")


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,48.0)]" in plan(spark, "top_failures")


def test_limits_before_the_shuffle(spark):
    for name in ("stage_cap", "top_failures"):
        assert "WindowGroupLimit" in plan(spark, name)
    assert "TakeOrderedAndProject" in plan(spark, "audit_recent")


def test_partial_aggregation(spark):
    for name in ("endpoint_metrics_15m", "trace_outcome", "reward_signals"):
        assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name,scans", [("feedback_gate", 5), ("retrain_strategy", 4)])
def test_feedback_is_counted_once(spark, name, scans):
    assert plan(spark, name).count("FileScan") <= scans


@pytest.mark.parametrize("name,scans", [("notebook_structures", 2), ("notebook_warnings", 2), ("section_code", 3), ("section_confidence", 3)])
def test_notebook_scans(spark, name, scans):
    df = QUERIES[name](spark, SF)
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("FileScan") <= scans and "SortAggregate" not in done
