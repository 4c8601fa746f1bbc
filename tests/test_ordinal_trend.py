"""Ordinals by counting cells and the line over them: same as one window per key, lazy, and skew-safe."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadence.operators.ordinal import CELL, cell_ordinal, ranked_cells, row_ordinal_window
from cadence.operators.trend import ordinal_trend_line, trend_line
from cadence.plans.registry import queries
from conftest import SMALL

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = [("hot", DAY + dt.timedelta(days=rng.randrange(4)), n, rng.random() * 90) for n in rng.sample(range(-20_000, 20_000), 3000)]
    out += [(f"k{rng.randrange(30)}", DAY + dt.timedelta(days=rng.randrange(900)), n, rng.random() * 9) for n in range(1500)]
    out += [("one", DAY, 5, 2.5), ("nulls", None, 4, 1.0), ("nulls", DAY, None, 2.0), ("nulls", None, None, 3.0), (None, DAY, 1, 1.0), (None, DAY, 2, 5.0)]
    return spark.createDataFrame(out, "k string, d date, n int, y double").cache()


@pytest.mark.parametrize("cell", [1, 7, CELL])
def test_ordinal_same_as_window(rows, cell):
    got = sorted(map(str, cell_ordinal(rows, "k", "d", "n", cell=cell).collect()))
    assert got == sorted(map(str, row_ordinal_window(rows, ["k"], ["d", "n"]).collect()))


def test_repeated_numbers_get_ordinals_of_their_own(spark):
    df = spark.createDataFrame([("a", DAY, 1)] * 50 + [("a", DAY, 0)], "k string, d date, n int")
    assert sorted(r.x for r in cell_ordinal(df, "k", "d", "n").collect()) == list(range(1, 52))


def test_line_same_as_fit_over_window_ordinals(rows):
    keyed = rows.where("k is not null")
    got = {(r.k, r.d, r.n): r.trend_line for r in ordinal_trend_line(keyed, "k", "d", "n", "y", digits=4, floor=0).collect()}
    want = {(r.k, r.d, r.n): r.trend_line for r in trend_line(row_ordinal_window(keyed, "k", ["d", "n"]), "k", "x", "y", digits=4, floor=0).collect()}
    assert got.keys() == want.keys() and len(got) > 4000
    assert all(abs(got[k] - want[k]) < 2e-4 for k in got)
    assert got["one", DAY, 5] == 2.5


def test_no_group_holds_more_than_a_cell(rows):
    ranked, cells = ranked_cells(rows, ["k"], "d", "n", cell=512)
    assert ranked.agg(F.max("__rank")).first()[0] <= 512
    assert cells.where("k = 'hot'").count() > 40


def test_trend_of_infrastructure_is_lazy_and_reads_facts_once(spark):
    """No job while planning, no checkpoint, and the table is derived once for anchors and rows."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "no job expected")
    queries()["iac_anchor"](spark, SMALL)  # the as-of of the folder, once
    before = len(tracker.getJobIdsForGroup("plan-only"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for key in ("iac_lead_time_trend", "iac_lead_time_weekly", "iac_by_member", "iac_count_weekly", "iac_supervised_cumulative"):
            plan = queries()[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert 1 <= plan.count("/lineitem.parquet") <= 2, key  # none where a job has run before
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(tracker.getJobIdsForGroup("plan-only")) == before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
