"""Composite operators beyond their oracle rows: nulls, ties, hot keys, plans, files."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.operators.checkpoint import pending_work, with_coverage
from cadence.operators.latest import ends_per_key, latest_per_key, order_code
from cadence.operators.means import bucket_mean, mean_states, merge_states, roll_up, state_mean
from cadence.operators.membership import member_rows, membership_counts, with_membership
from cadence.operators.period import latest_anchor, trailing_period, with_anchor
from cadence.operators.related import first_related, last_related, related_only
from cadence.operators.usages import extract_usages
from cadence.plans import reviews, workflows
from cadence.plans.dashboard import DASHBOARDS, WEEKLY, frames, pr_weekly_results, read_metric, write_by_metric
from cadence.plans.registry import queries
from cadence.sources.bound import bind, bound_as_of, bound_defaults
from cadence.sources.landed import parse_tracker_lines
from cadence.sources.slices import read_sliced, sliced_period, write_sliced
from cadence.sources.tables import read_tables, replace_all, replace_partitions
from conftest import SMALL

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- latest_per_key ---

@pytest.fixture(scope="module")
def versions(spark):
    rng = random.Random(2)
    out = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}"
        out.append((key, rng.choice([None, True, False]), rng.choice([None, -2**31, 0, 7, 2**31 - 1]), rng.choice([None, T0, T0 + dt.timedelta(seconds=rng.randrange(9))]),
                    rng.choice([None, -2**63, 2**63 - 1, 3]), rng.choice([None, "", "a", "é"]), f"p{i}"))
    return spark.createDataFrame(out, "k string, b boolean, i int, t timestamp_ntz, n bigint, s string, payload string").cache()


@pytest.mark.parametrize("order", [["i", "payload"], ["b", "t", "payload"], ["n", "b", "i", "s", "payload"], ["s", "i", "payload"],
                                   [["t", ["i", "b"]], "payload"]])
def test_latest_same_as_window(versions, order):
    def nested(x):
        return F.col(x) if isinstance(x, str) else F.struct(*[nested(y) for y in x])

    flat = order = [nested(c) for c in order]
    for last in (True, False):
        w = Window.partitionBy("k").orderBy(*[c.desc_nulls_last() if last else c.asc_nulls_first() for c in flat])
        want = versions.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("k", "payload", "s")
        assert rows(latest_per_key(versions, "k", order, ["payload", "s"], last)) == rows(want)


def test_latest_ties_empty_tables_and_plan(spark, versions):
    assert rows(latest_per_key(versions, "k", ["b"], ["i"])) == rows(latest_per_key(versions.repartition(7), "k", ["b"], ["i"]))
    assert latest_per_key(versions.limit(0), "k", ["i"]).count() == 0
    got = ends_per_key(versions, ["k"], ["n", "payload"], first=["payload"], last=["i"])
    assert got.columns == ["k", "payload", "i"] and got.count() == versions.select("k").distinct().count()
    for key in ("latest_per_key", "ends_per_key"):
        assert "SortAggregate" not in plan(queries()[key](spark, SMALL))


def test_order_code_widths(versions):
    kinds = {f.name: f.dataType for f in versions.schema.fields}
    code, held = order_code([(F.col(c), kinds[c]) for c in ("b", "i")])
    assert held == 2 and versions.select(code.alias("c")).schema["c"].dataType.simpleString() == "bigint"
    code, held = order_code([(F.col(c), kinds[c]) for c in ("t", "i", "n")])
    assert held == 2 and versions.select(code.alias("c")).schema["c"].dataType.simpleString() == "decimal(38,0)"
    assert order_code([(F.col("s"), kinds["s"])]) == (None, 0)


# --- stored slices ---

@pytest.fixture(scope="module")
def runs(spark):
    out = [(i, i % 9 if i % 40 else None, None if i % 33 == 0 else T0 + dt.timedelta(hours=i) - (dt.timedelta(days=800) if i % 9 == 4 else dt.timedelta()))
           for i in range(3000)]
    return spark.createDataFrame(out, "id bigint, repo int, at timestamp_ntz").cache()


@pytest.mark.parametrize("upper", [False, True])
def test_sliced_period_same_as_trailing_period(spark, runs, tmp_path, upper):
    stored = write_sliced(runs, str(tmp_path), "repo", "at", groups=4)
    anchors = latest_anchor(runs.where("repo is not null"), "repo", "at", T0, "max_date")
    want = trailing_period(with_anchor(runs, anchors, "repo", "max_date"), "at", 20, anchor="max_date", upper=upper)
    got = sliced_period(read_sliced(spark, str(tmp_path), "repo", "at", groups=4), 20, upper=upper)
    assert rows(got.select(*want.columns)) == rows(want)
    assert "dynamicpruning" in plan(got)
    assert stored.facts.count() == runs.count()


def test_a_stale_key_does_not_open_old_files_of_others(spark, tmp_path):
    """Old files of the repositories that go on hold junk; only a reader of them would notice."""
    out = [(i, i % 8, T0 + dt.timedelta(days=(0 if i % 8 == 5 else 900 * (i >= 400)))) for i in range(800)]
    df = spark.createDataFrame(out, "id bigint, repo int, at timestamp_ntz")
    stored = write_sliced(df, str(tmp_path / "s"), "repo", "at", groups=1 << 20)
    month = (T0.year * 100 + T0.month) << 20
    stale = month + next(r.g for r in df.where("repo = 5").select(F.pmod(F.xxhash64("repo"), F.lit(1 << 20)).alias("g")).limit(1).collect())
    spoiled = 0
    for f in glob.glob(f"{tmp_path}/s/facts/slice=*/*.parquet"):
        s = int(os.path.basename(os.path.dirname(f)).split("=")[1])
        if month <= s < month + (1 << 20) and s != stale:
            open(f, "wb").write(b"junk")
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
            spoiled += 1
    assert spoiled >= 7
    facts = spark.read.schema(stored.facts.schema).parquet(f"{tmp_path}/s/facts")
    stored.facts = facts
    assert sorted(r.repo for r in sliced_period(stored, 30).select("repo").distinct().collect()) == list(range(8))


def test_period_without_end_needs_its_own_anchor(spark, runs, tmp_path):
    stored = write_sliced(runs.withColumn("other", F.col("at")), str(tmp_path), "repo", "at", anchor="other")
    with pytest.raises(ValueError):
        sliced_period(stored, 5)


def test_workflow_metrics_over_slices(spark, tmp_path):
    t, d = bind(spark, SMALL), bound_defaults()
    as_of = bound_as_of(t)
    want = {k: rows(workflows.METRICS[k](t, days=10, as_of=as_of, d=d)) for k in ("wf_deployments_weekly", "wf_run_count", "wf_failures")}
    runs = t.need("workflow_runs")
    stored = bind(spark, SMALL)
    stored.sliced = {("workflow_runs", "created_at"): write_sliced(runs, f"{tmp_path}/c", "repository_id", "created_at"),
                     ("workflow_runs", "updated_at"): write_sliced(runs, f"{tmp_path}/u", "repository_id", "updated_at", "created_at")}
    assert {k: rows(workflows.METRICS[k](stored, days=10, as_of=as_of, d=d)) for k in want} == want


# --- related rows ---

@pytest.mark.parametrize("kinds", ["int bigint", "bigint int", "string string"])
def test_prefilter_loses_no_related_row(spark, kinds):
    a, b = kinds.split()
    parents = spark.range(0, 20_000, 7).select(F.col("id").cast(a).alias("id")).unionByName(spark.createDataFrame([(None,)], f"id {a}"))
    other = spark.range(0, 60_000).select((F.col("id") % 30_000).cast(b).alias("key"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"))
    kept = related_only(other, "key", parents, "id")
    assert kept.join(parents, F.col("key") == F.col("id"), "left_semi").count() == other.join(parents, F.col("key") == F.col("id"), "left_semi").count()
    assert kept.count() < 0.2 * other.count()
    for f in (first_related, last_related):
        assert rows(f(parents, other, ("id", "key"), "at", prefilter=True)) == rows(f(parents, other, ("id", "key"), "at"))


def test_filter_has_a_bound(spark):
    parents = spark.range(100_000)
    assert related_only(parents.withColumnRenamed("id", "key"), "key", parents, "id", words=64).count() == 100_000


def test_reviews_over_stored_tables(spark, tmp_path):
    t, d = bind(spark, SMALL), bound_defaults()
    as_of = bound_as_of(t)
    for name in ("repositories", "pull_requests", "pull_request_reviews"):
        t.need(name).write.parquet(f"{tmp_path}/{name}")
    stored = read_tables(spark, str(tmp_path), ["repositories"])
    stored.pull_requests, stored.pull_request_reviews = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("pull_requests", "pull_request_reviews"))
    for key in ("review_avg_time_to_first", "review_time_to_first_weekly", "review_avg_time_to_merge", "review_time_to_merge_weekly"):
        got = reviews.METRICS[key](stored, days=300, as_of=as_of, d=d)
        assert rows(got) == rows(reviews.METRICS[key](t, days=300, as_of=as_of, d=d))
        shown = plan(got)
        scan = shown.index("FileScan parquet [pull_request_id")
        below = shown[:scan].rsplit("Exchange hashpartitioning", 1)[-1]
        assert "getbit" in below, key  # between the last shuffle and the scan of the reviews


# --- means ---

def test_states_roll_up_like_facts(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), T0 + dt.timedelta(hours=rng.randrange(9000)), rng.choice([None, rng.randrange(100)]))
                                for _ in range(2000)] + [("empty", T0, None)], "k string, t timestamp_ntz, v int")
    days = mean_states(df, "k", "t", "v")
    wide = roll_up(days, "k", ["week", "month", "year"]).select("k", "grain", "slot", state_mean().alias("mean"))
    for grain in ("week", "month", "year"):
        want = bucket_mean(df, "k", "t", "v", grain)
        assert rows(wide.where(F.col("grain") == grain).select("k", "slot", "mean")) == rows(want)
    halves = mean_states(df.where("v % 2 = 0"), "k", "t", "v").unionByName(mean_states(df.where("v % 2 = 1 or v is null"), "k", "t", "v"))
    assert rows(merge_states(halves, "k")) == rows(days)
    assert [r["mean"] for r in bucket_mean(df.where("k = 'empty'"), "k", "t", "v").collect()] == [None]


# --- membership ---

def test_team_of_a_hundred_thousand(spark):
    team = spark.range(100_000).select(F.concat(F.lit("user"), F.col("id").cast("string")).alias("username"))
    team = team.unionByName(team.limit(500)).unionByName(spark.createDataFrame([(None,)], "username string"))
    prs = spark.range(5000).select("id", F.concat(F.lit("user"), (F.col("id") * 37 % 200_000).cast("string")).alias("author"),
                                   F.concat(F.lit("user"), (F.col("id") * 91 % 200_000).cast("string")).alias("merged_by"))
    member = lambda n: n < 100_000
    want = sorted((f"user{x}", 1) for i in range(5000) for x in dict.fromkeys([i * 37 % 200_000, i * 91 % 200_000]) if member(x))
    got = member_rows(prs, team, ["author", "merged_by"]).select("member", F.lit(1))
    assert rows(got) == want
    assert with_membership(prs, team, ["author"]).where("is_member_author").count() == sum(member(i * 37 % 200_000) for i in range(5000))


def test_membership_of_nulls(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, None, "b"), (1, "x", None), (2, "x", "y"), (2, "b", "a")], "k int, author string, merged_by string")
    team = spark.createDataFrame([("a",), ("b",), (None,)], "username string")
    got = membership_counts(df, team, ["author", "merged_by"], "k", [F.count(F.lit(1)).alias("n")])
    assert rows(got) == [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 1)]
    flags = rows(with_membership(df, team, ["author", "merged_by"]).select("author", "merged_by", "is_member_author", "is_member_merged_by"))
    assert (None, "b", None, True) in flags and ("x", "y", False, False) in flags and ("x", None, False, None) in flags


# --- pending work ---

def test_coverage_against_all_pairs(spark):
    rng = random.Random(6)
    day = lambda n: T0 + dt.timedelta(days=n)
    log, done = [], []
    for i in range(400):
        key, since, end = f"e{rng.randrange(6)}", rng.randrange(300), rng.randrange(0, 60)
        status = rng.choice(["done", "failed", "running", "interrupted"])
        log.append((str(i), key, None, day(since), "running", day(since)))
        if status != "running":
            log.append((str(i), key, None, day(since), status, day(since + end)))
        if status == "done":
            done.append((key, day(since), day(since + end)))
    asked = [(i, rng.choice([f"e{rng.randrange(8)}", None]), rng.choice([None, *[day(rng.randrange(-9, 380))] * 9]), None) for i in range(600)]
    asked += asked[:20]
    requested = spark.createDataFrame(asked, "n int, entity_type string, since_date timestamp_ntz, extra string")
    log_df = spark.createDataFrame(log, "run_id string, entity_type string, repository_id int, since_date timestamp_ntz, status string, at timestamp_ntz")
    covered = lambda r: r[1] is not None and r[2] is not None and any(k == r[1] and s <= r[2] <= c for k, s, c in done)
    want = sorted((r for r in asked if not covered(r)), key=str)
    assert rows(pending_work(requested, log_df)) == want and len(want) < len(asked)
    assert rows(pending_work(requested, log_df.limit(0))) == sorted(asked, key=str)
    assert pending_work(requested, log_df, force=True).count() == len(asked)
    assert "BroadcastNestedLoopJoin" not in plan(with_coverage(requested, log_df))


# --- replacement in place ---

def test_untouched_partitions_keep_their_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", ["a", "b", "07", None][i % 4]) for i in range(100)], "id int, v string, repo string")
    path = str(tmp_path / "t")
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/repo=*/*.parquet")}
    assert rows(replace_partitions(df, path, "repo")) == rows(df)
    before = files()
    batch = df.where("repo = 'b' and id < 20").withColumn("v", F.lit("new"))
    want = rows(df.where("repo <> 'b' or repo is null").unionByName(batch))
    assert rows(replace_partitions(batch, path, "repo")) == want
    assert {f: t for f, t in files().items() if "repo=b" not in f} == {f: t for f, t in before.items() if "repo=b" not in f}
    now = files()
    assert rows(replace_partitions(batch.limit(0), path, "repo")) == want and files() == now


def test_empty_import_does_not_wipe_a_table(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    assert replace_all(df, path) and not replace_all(df.limit(0), path)
    assert spark.read.parquet(path).count() == 5


# --- results in one pass ---

def test_weekly_results_in_one_pass(spark, tmp_path):
    t, d = bind(spark, SMALL), bound_defaults()
    as_of = bound_as_of(t)
    long = pr_weekly_results(t, days=400, as_of=as_of, d=d)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(pr_weekly_results(t, days=400, as_of=as_of, d=d)).count("/lineitem.parquet") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    write_by_metric(long, str(tmp_path / "r"))
    own = frames(t, "pull-requests", 400, as_of, d)
    for metric in WEEKLY:
        got = read_metric(spark, str(tmp_path / "r"), metric)
        assert rows(got.select(*own[metric].columns)) == rows(own[metric])


def test_frames_of_every_dashboard(spark):
    t, d = bind(spark, SMALL), bound_defaults()
    named = {n for x in DASHBOARDS for n in frames(t, x, 120, bound_as_of(t), d)}
    assert len(named) == 58 and named <= set(queries())


# --- usages and tracker lines ---

def test_usages_of_files_that_repeat(spark):
    files = spark.createDataFrame([
        ("r", "f", "uses: x/(a+b)/one@v1\nuses: x/(a+b)/one@v2\nuses: x/(a+b)/two"), ("r", "g", "uses: x/(a+b)/one\nuses: x/(a+b)/one@v3"),
        ("r", "g", "no\nuses: x/(a+b)/two@v4 uses: x/(a+b)/one@v5"), ("", "f", "uses: x/(a+b)/one"), ("r", None, "uses: x/(a+b)/one"), ("r", "h", None)],
        "repository string, caller_file string, content string")
    got = rows(extract_usages(files, "content", "x/(a+b)/"))
    assert got == [("r", "f", "x/(a+b)/one", "v1"), ("r", "f", "x/(a+b)/two", None), ("r", "g", "x/(a+b)/one", None), ("r", "g", "x/(a+b)/two", "v4")]
    assert "SortAggregate" not in plan(extract_usages(files, "content", "x/"))
    odd = spark.createDataFrame([("r", "f", "uses: a\\E.b/c@1")], files.schema)
    assert rows(extract_usages(odd, "content", "a\\E.b/")) == [("r", "f", "a\\E.b/c", "1")]


def test_tracker_lines_of_several_files(spark):
    lines = [("a", 0, "Priorità,Data di invio"), ("a", 1, 'High,"3/2/24, 9:5"'), ("b", 5, " "), ("b", 6, "Data di invio,Tipologia"), ("b", 7, "2024-05-06,x"),
             ("only-head", 1, "Data di invio")]
    got = parse_tracker_lines(spark.createDataFrame(lines, "file string, at int, value string"))
    assert rows(got.select("submitted_at", "category", "priority")) == [(dt.datetime(2024, 2, 3, 9, 5), "", "High"), (dt.datetime(2024, 5, 6), "x", "")]
