"""Plan hygiene for every registered query: no cartesian products or nested-loop
joins, Python only where an operator needs it, and pushdown where it applies."""

import pytest

from ledgerline.plans.registry import QUERIES

from fixture_paths import SF_SMALL

# queries whose plan runs Python by design (per-partition BLAS scoring, sequential per-key streams)
PYTHON_OK = {"kb_search_lists_recall", "kb_search", "kb_search_strict", "memory_search", "kb_search_ivf", "kb_search_ivf_recall",
             "usage_log", "rate_verdicts"}


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_python_only_where_needed(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    py = any(op in plan for op in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"))
    assert py == (name in PYTHON_OK)


@pytest.mark.parametrize("name, pushed", [
    ("finance_monthly_trend", "GreaterThanOrEqual(l_shipdate"),
    ("dashboard_stats", "GreaterThanOrEqual(ts"),
    ("dashboard_stats", "GreaterThanOrEqual(l_shipdate"),
    ("snapshot_30d", "GreaterThanOrEqual(o_orderdate"),
    ("ai_performance", "GreaterThanOrEqual(ts"),
])
def test_time_filters_reach_the_scan(spark, name, pushed):
    assert pushed in _plan(spark, name)


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "finance_totals")
    assert "l_returnflag" not in plan and "l_discount" not in plan


@pytest.mark.parametrize("name, scans", [
    ("business_context", 5), ("insert_metrics", 3), ("rights_optout", 4), ("upsert_services", 6), ("snapshot_30d", 3),
])
def test_scans_stay_few(spark, name, scans):
    assert _plan(spark, name).count("FileScan parquet") <= scans


def test_building_a_query_starts_no_job(spark):
    """Beyond reading a schema a table: no counts or collects while a plan is built (clustering and the matcher's
    checkpoints aside)."""
    eager = {"recent_movements", "conversation_page_deep", "weekly_trends", "kb_search_lists", "kb_search_lists_recall", "kb_search_ivf", "kb_search_ivf_recall", "match_replies", "apply_ratings", "apply_ratings_rejects",
             "training_pairs", "training_pair_stats"}
    tracker = spark.sparkContext.statusTracker()
    for name in sorted(set(QUERIES) - eager):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        try:
            QUERIES[name](spark, SF_SMALL)
            assert len(tracker.getJobIdsForGroup(f"build-{name}")) <= 12, name
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"build-{name}")
                      for s in tracker.getJobInfo(j).stageIds]
            assert all(s is None or s.numTasks == 1 for s in stages), name
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
