"""All results of a dashboard: as frames by name, or its weekly PR means in one pass over the facts (K-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import elapsed_seconds, not_draft, not_in, round_half_up, to_week
from cadence.functions.predicates import since
from cadence.operators.period import resolve_as_of
from cadence.plans import adoption, iac, pull_requests, releases, reviews, team, tracker, workflows
from cadence.plans.common import REPO, with_repo
from cadence.sources.tables import Tables

#: Metrics of a dashboard by name, and whether they take a period.
DASHBOARDS = {
    "pull-requests": (pull_requests.METRICS, True),
    "pull-requests-review": (reviews.METRICS, True),
    "workflows": (workflows.METRICS, True),
    "iac": (iac.METRICS, True),
    "dx-adoption": (adoption.METRICS, False),
    "dx-team": (team.METRICS, True),
    "tracker": (tracker.METRICS, False),
    "releases": (releases.METRICS, False),
}


def frames(t: Tables, dashboard: str, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> dict[str, DataFrame]:
    """Every result of a dashboard as a lazy frame; ``write_results`` stores them."""
    metrics, has_period = DASHBOARDS[dashboard]
    out = {name: fn(t, days=days, as_of=as_of, d=d) if has_period else fn(t, d=d) for name, fn in metrics.items()}
    if dashboard == "dx-team":
        out.update({name: fn(t, d=d) for name, fn in team.STATIC.items()})
    return out


#: Weekly series and the column of their value in their own frame.
WEEKLY = {
    "pr_lead_time_weekly": "avg_lead_time_days",
    "pr_size_weekly": "avg_additions",
    "pr_comments_weekly": "avg_comments",
    "pr_comments_by_size_weekly": "avg_comments_per_addition",
    "pr_lead_time_trend": "trend_line",
}


def pr_weekly_results(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """The five weekly PR series as (metric, repository, week, value), from one reading of the PRs.

    A PR gives a tagged row for each series it counts in, and one grouping by
    (metric, repository, week) sums them all; a series that two metrics share is tagged
    once. The trend is fitted to the weekly means, a row a week.
    """
    now = resolve_as_of(as_of)
    p = with_repo(t.need("pull_requests"), t)
    created = since("created_at", now, days)
    merged = since("merged_at", now, days) & F.col("created_at").isNotNull() & not_in("author", d.bots) & not_draft()

    def tag(name: str, holds, week, a, b=None):
        none = F.lit(None).cast("double")
        return F.when(holds, F.struct(F.lit(name).alias("tag"), to_week(week).alias("week"), a.cast("double").alias("a"),
                                      (none if b is None else b.cast("double")).alias("b")))

    lead = elapsed_seconds("created_at", "merged_at") / 86400.0
    tags = F.array_compact(F.array(
        tag("lead", merged, "merged_at", lead), tag("created", created, "created_at", F.col("total_comments_count"), F.col("additions"))))
    rows = p.select(REPO, F.inline(tags))
    means = rows.groupBy("tag", REPO, "week").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    value = F.when(F.col("metric") == "pr_lead_time_weekly", F.col("a")).when(F.col("metric") == "pr_size_weekly", F.col("b")).when(
        F.col("metric") == "pr_comments_weekly", F.col("a")).otherwise(F.try_divide(F.col("a"), F.nullif(F.col("b"), F.lit(0.0))))
    names = F.when(F.col("tag") == "lead", F.array(F.lit("pr_lead_time_weekly"))).otherwise(
        F.array(*[F.lit(x) for x in ("pr_size_weekly", "pr_comments_weekly", "pr_comments_by_size_weekly")]))
    series = means.withColumn("metric", F.explode(names)).where((F.col("metric") != "pr_size_weekly") | F.col("b").isNotNull())
    series = series.select("metric", REPO, "week", round_half_up(value, 2).alias("value"))
    # the trend needs its own series twice, points and line; both come from the rows of one metric and repository
    w = Window.partitionBy("metric", REPO)
    x = F.row_number().over(w.orderBy("week")).cast("double")
    points = series.withColumn("x", x)
    slope = F.coalesce(F.regr_slope("value", "x").over(w), F.lit(0.0))
    fitted = round_half_up(slope * F.col("x") + (F.avg("value").over(w) - slope * F.avg("x").over(w)), 2)
    both = points.withColumn("fitted", fitted)
    out = F.array(F.struct("metric", F.col("value").alias("value")), F.when(
        F.col("metric") == "pr_lead_time_weekly", F.struct(F.lit("pr_lead_time_trend").alias("metric"), F.col("fitted").alias("value"))))
    return both.select(REPO, "week", F.inline(F.array_compact(out))).select("metric", REPO, "week", "value")


def write_by_metric(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store long results as one folder a metric (``metric=<name>``), written in one pass."""
    results.hint("rebalance", F.col("metric")).write.mode(mode).partitionBy("metric").parquet(path)


def read_metric(spark, path: str, metric: str) -> DataFrame:
    """One metric of ``write_by_metric`` under the column name of its own frame; other folders are not opened."""
    frame = spark.read.parquet(path).where(F.col("metric") == metric).drop("metric").withColumnRenamed("value", WEEKLY[metric])
    return frame.withColumnRenamed("week", "date") if metric == "pr_lead_time_trend" else frame
