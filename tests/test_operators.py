"""Edge rows (FIXTURES.md §C), two formulations and laws for the operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cadence.config import DEFAULTS
from cadence.functions import first_int, pg_initcap, to_day
from cadence.operators.calendar import calendar, open_per_day, period_calendar
from cadence.operators.ordinal import row_ordinal, row_ordinal_window
from cadence.operators.period import resolve_as_of
from cadence.operators.related import last_related
from cadence.operators.shape import pivot_forward_fill, size_bucket
from cadence.operators.trend import trend_change_pct, trend_line
from cadence.operators.versions import release_summary, version_drift
from cadence.plans import pull_requests as pr
from cadence.plans import team
from cadence.sources.tables import Tables

D = dt.datetime
PR_SCHEMA = ("id bigint, repository_id int, number bigint, title string, author string, merged_by string, "
             "created_at timestamp_ntz, merged_at timestamp_ntz, closed_at timestamp_ntz, additions bigint, "
             "total_comments_count bigint, draft int")


def _repos(spark):
    return spark.createDataFrame([(1, "a", "org/a", "org"), (2, "b", "org/b", "org")],
                                 "id int, name string, full_name string, organization string")


def _pr(i, created, merged=None, closed=None, author="x", additions=10, comments=1, draft=0, repo=1):
    return (i, repo, i, f"t{i}", author, "m", created, merged, closed, additions, comments, draft)


def test_null_author_dropped_by_bot_filter(spark):
    rows = [_pr(1, D(2024, 1, 1), author=None), _pr(2, D(2024, 1, 2), author="ok")]
    t = Tables(repositories=_repos(spark), pull_requests=spark.createDataFrame(rows, PR_SCHEMA))
    out = {r["repository"]: r["total_prs"] for r in pr.pr_total(t, 30, D(2024, 1, 10)).collect()}
    assert out == {"org/a": 1, "org/b": 0}


def test_zero_card_is_null_in_card_view(spark):
    t = Tables(repositories=_repos(spark), pull_requests=spark.createDataFrame([], PR_SCHEMA))
    row = pr.pr_cards(t, 30, D(2024, 1, 10)).where("repository = 'org/a'").first()
    assert row["total_prs"] is None and row["avg_lead_time_days"] is None and row["total_comments"] is None


def test_size_bucket_edges(spark):
    vals = [50, 51, 200, 201, 500, 501, 1000, 1001]
    df = spark.createDataFrame([(v,) for v in vals], "a bigint")
    label, order = size_bucket("a", DEFAULTS.size_edges, DEFAULTS.size_labels)
    got = [(r[0], r[1]) for r in df.select(label, order).collect()]
    assert got == [("0-50", 1), ("51-200", 2), ("51-200", 2), ("201-500", 3), ("201-500", 3),
                   ("501-1000", 4), ("501-1000", 4), ("1000+", 5)]


def test_calendar_grain_switch(spark):
    keys = spark.createDataFrame([("r",)], "repository string")
    asof = D(2024, 6, 12)  # a Wednesday
    days239 = [r["date"] for r in period_calendar(keys, 239, asof).collect()]
    days240 = [r["date"] for r in period_calendar(keys, 240, asof).collect()]
    assert len(days239) == 240 and days239[-1] == dt.date(2024, 6, 12)
    assert all(d.weekday() == 0 for d in days240) and days240[-1] == dt.date(2024, 6, 10)


def open_per_day_interval_join(df, key, start, end, as_of=None,
                               name="date", count_name="open_prs"):
    """The direct interval-join form of :func:`open_per_day` (it plans a nested-loop join)."""
    now = resolve_as_of(as_of)
    today = to_day(now)
    items = df.select(F.col(key), to_day(start).alias("__s"),
                      F.coalesce(to_day(end), F.date_add(today, 1)).alias("__e"))
    bounds = df.groupBy(key).agg(F.min(to_day(start)).alias("__start"))
    cal = calendar(bounds, F.col("__start"), today, 1, name).select(key, name)
    j = cal.alias("c").join(
        items.alias("i"),
        (F.col(f"c.{key}") == F.col(f"i.{key}")) & (F.col(f"c.{name}") >= F.col("i.__s"))
        & (F.col(f"c.{name}") < F.col("i.__e")),
        "left",
    )
    return j.groupBy(F.col(f"c.{key}").alias(key), F.col(f"c.{name}").alias(name)).agg(
        F.count("i.__s").alias(count_name)
    )


def test_open_per_day_equals_interval_join(spark):
    random.seed(7)
    rows = []
    for i in range(300):
        c = D(2024, 1, 1) + dt.timedelta(days=random.randint(0, 60))
        kind = random.random()
        closed = None if kind < 0.2 else (c if kind < 0.3 else c + dt.timedelta(days=random.randint(1, 40)))
        rows.append((random.choice(["a", "b"]), c, closed))
    df = spark.createDataFrame(rows, "repository string, created_at timestamp_ntz, closed_at timestamp_ntz")
    asof = D(2024, 3, 15)
    a = sorted(tuple(r) for r in open_per_day(df, "repository", "created_at", "closed_at", asof).collect())
    b = sorted(tuple(r) for r in open_per_day_interval_join(df, "repository", "created_at", "closed_at",
                                                            asof).collect())
    assert a == b
    plan = open_per_day(df, "repository", "created_at", "closed_at", asof)._jdf.queryExecution().executedPlan()
    assert "NestedLoop" not in plan.toString()


def test_empty_input_gives_empty_calendar(spark):
    df = spark.createDataFrame([], "repository string, created_at timestamp_ntz, closed_at timestamp_ntz")
    assert open_per_day(df, "repository", "created_at", "closed_at", D(2024, 1, 1)).count() == 0


def test_last_approval_null_first(spark):
    prs = spark.createDataFrame([(1,), (2,)], "id bigint")
    rv = spark.createDataFrame(
        [(1, "APPROVED", None), (1, "APPROVED", D(2024, 1, 2)), (2, "APPROVED", D(2024, 1, 3)),
         (2, "COMMENTED", D(2024, 1, 9))],
        "pull_request_id bigint, state string, submitted_at timestamp_ntz",
    )
    ref = {r["id"]: r["last_ts"] for r in last_related(prs, rv, ("id", "pull_request_id"), "submitted_at",
                                                       where=F.col("state") == "APPROVED").collect()}
    ign = {r["id"]: r["last_ts"] for r in last_related(prs, rv, ("id", "pull_request_id"), "submitted_at",
                                                       where=F.col("state") == "APPROVED",
                                                       nulls="ignore").collect()}
    assert ref == {1: None, 2: D(2024, 1, 3)}
    assert ign == {1: D(2024, 1, 2), 2: D(2024, 1, 3)}


def test_one_point_trend_rules(spark):
    pts = spark.createDataFrame([("r", 1, 5.0)], "k string, x int, y double")
    zero = trend_line(pts, "k", "x", "y", degenerate="zero").first()["trend_line"]
    null = trend_line(pts, "k", "x", "y", degenerate="null").first()["trend_line"]
    pct = trend_change_pct(pts, "k", "x", "y").first()["trend_pct"]
    assert zero == 5.0 and null is None and pct is None


def test_trend_matches_sums_form(spark):
    random.seed(3)
    ys = [random.randint(0, 20) for _ in range(30)]
    pts = spark.createDataFrame([("r", i + 1, float(y)) for i, y in enumerate(ys)], "k string, x int, y double")
    n = len(ys)
    sx, sy = sum(range(1, n + 1)), sum(ys)
    sxy = sum((i + 1) * y for i, y in enumerate(ys))
    sxx = sum((i + 1) ** 2 for i in range(n))
    slope = (sxy * n - sx * sy) / (sxx * n - sx * sx)
    icpt = (sy - slope * sx) / n
    got = {r["x"]: r["trend_line"] for r in trend_line(pts, "k", "x", "y").collect()}
    for x, v in got.items():
        assert abs(v - round(slope * x + icpt, 2)) < 0.006


def test_drift_statuses(spark):
    uses = spark.createDataFrame(
        [("r", "acme-dx/m/azurerm", "f", None), ("r", "acme-dx/m/azurerm", "f", "main"),
         ("r", "acme-dx/m/azurerm", "f", "~> 2.1"), ("r", "acme-dx/m/azurerm", "f", ">= 1, < 3"),
         ("r", "acme-dx/m/azurerm", "f", "~> 3.0"), ("r", "acme-dx/zz/azurerm", "f", "~> 1.0")],
        "repository string, module string, file_path string, version string",
    )
    rel = spark.createDataFrame([("m", "azurerm", 2, "2.4.0"), ("m", "aws", 1, "1.0.0")],
                                "module_name string, provider string, major_version int, latest_version string")
    got = [r["drift_status"] for r in version_drift(uses, rel, DEFAULTS.dx_module_markers).collect()]
    assert sorted(got) == sorted(["unknown", "unknown", "up-to-date", "outdated", "unknown", "unknown"])


def test_version_order_and_skips(spark):
    v = spark.createDataFrame(
        [("m", "p", x, D(2024, 1, i + 1)) for i, x in enumerate(["v1.2.0", "1.10.0", "1.9.0", "2", "x.y", "2.0.1"])],
        "module_name string, provider string, version string, published_at timestamp_ntz",
    )
    got = {r["major_version"]: r for r in release_summary(v).collect()}
    assert set(got) == {1, 2}
    assert got[1]["first_release_version"] == "v1.2.0" and got[1]["latest_version"] == "1.10.0"
    assert got[1]["releases_count"] == 3
    assert got[2]["first_release_version"] == "2.0.1" and got[2]["releases_count"] == 1


def test_pg_initcap_and_first_int(spark):
    df = spark.createDataFrame([("4-not SPECIFIED",), ("hello_world x2nd",), ("~> 12.3",)], "s string")
    got = [r[0] for r in df.select(pg_initcap("s")).collect()]
    assert got == ["4-Not Specified", "Hello_World X2nd", "~> 12.3"]
    assert [r[0] for r in df.select(first_int("s")).collect()] == [4, 2, 12]


def test_pivot_forward_fill_matches_loop(spark):
    random.seed(11)
    rows, dates = [], [dt.date(2024, 1, d) for d in range(1, 21)]
    for d in dates:
        for lab in ("A", "B", "C"):
            if random.random() < 0.5:
                rows.append(("r", d, lab, random.randint(0, 9)))
    df = spark.createDataFrame(rows, "k string, run_date date, lab string, v bigint")
    out = {r["run_date"]: (r["a"], r["b"]) for r in pivot_forward_fill(
        df, "k", "run_date", "lab", "v", {"A": "a", "B": "b"}).collect()}
    # the original loop
    points = {}
    for _, d, lab, v in sorted(rows, key=lambda r: (r[1], r[2])):
        key = {"A": "a", "B": "b"}.get(lab)
        if key is None:
            continue
        points.setdefault(d, {"a": 0, "b": 0})[key] = v
    ordered = sorted(points)
    for i in range(1, len(ordered)):
        for s in ("a", "b"):
            if points[ordered[i]][s] == 0 and points[ordered[i - 1]][s] > 0:
                points[ordered[i]][s] = points[ordered[i - 1]][s]
    assert out == {d: (p["a"], p["b"]) for d, p in points.items()}


def test_row_ordinal_matches_window_under_skew(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.7 else f"k{random.randint(0, 4)}", random.randint(0, 30), i)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, d int, n int")
    a = sorted(tuple(r) for r in row_ordinal(df, "k", ["d", "n"], partitions=7).collect())
    b = sorted(tuple(r) for r in row_ordinal_window(df, "k", ["d", "n"]).collect())
    assert a == b


def test_team_split_null_author_counts_nowhere(spark):
    rows = [_pr(1, D(2024, 1, 1), author=None), _pr(2, D(2024, 1, 1), author="BUILDING"),
            _pr(3, D(2024, 1, 1), author="other")]
    t = Tables(repositories=_repos(spark), pull_requests=spark.createDataFrame(rows, PR_SCHEMA),
               dx_team_members=spark.createDataFrame([("BUILDING",)], "username string"))
    got = team.team_pr_split(t, 30, D(2024, 1, 10)).where("repository = 'org/a' and date = '2024-01-01'").first()
    assert (got["dx_pr"], got["non_dx_pr"]) == (1, 1)


def test_slice_law(spark):
    """A metric for all repositories, filtered to one, equals the metric on
    that repository's rows alone."""
    rows = [_pr(i, D(2024, 1, 1 + i % 20), D(2024, 1, 3 + i % 20), repo=1 + i % 2) for i in range(40)]
    t = Tables(repositories=_repos(spark), pull_requests=spark.createDataFrame(rows, PR_SCHEMA))
    one = Tables(repositories=_repos(spark).where("id = 1"),
                 pull_requests=spark.createDataFrame([r for r in rows if r[1] == 1], PR_SCHEMA))
    a = sorted(tuple(r) for r in pr.pr_lead_time_weekly(t, 60, D(2024, 2, 1)).where("repository = 'org/a'").collect())
    b = sorted(tuple(r) for r in pr.pr_lead_time_weekly(one, 60, D(2024, 2, 1)).collect())
    assert a == b and a
