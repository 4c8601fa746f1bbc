"""Plan checks: no nested-loop or cartesian joins in any registered query, and
scans read only the columns they need."""

import pytest

from cadence.plans.registry import queries
from conftest import SMALL

QUERIES = queries()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_nested_loop_or_cartesian(spark, key):
    plan = QUERIES[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_pruned_scan(spark):
    """Scans read only the columns a metric needs (column pruning reaches parquet)."""
    plan = QUERIES["pr_total"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for unused in ("l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal", "c_name"):
        assert unused not in plan, unused
    plan = QUERIES["wf_run_count"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_filters_pushed_to_scan(spark):
    plan = QUERIES["pr_total"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), Not(EqualTo(c_mktsegment,MACHINERY))" in plan


def test_bound_of_the_period_reaches_the_scan_of_runs(spark):
    """The earliest begin of all repositories' periods is a filter of the scan of the runs."""
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = QUERIES["wf_failures"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "event_type" in line]
    filters = scans[0].split("DataFilters: ")[1].split("Format:")[0].lower()
    assert len(scans) == 1 and (">= subquery" in filters or ">= scalar-subquery" in filters)
