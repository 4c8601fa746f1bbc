"""Pull-request metrics, all repositories at once (anchor: ``as_of``).

Every function returns a lazy DataFrame with ``repository`` first. Filters
differ between sibling metrics on purpose (bots, drafts, bounds); they are the
semantics of each chart and are kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import elapsed_seconds, not_draft, not_in, round_half_up, to_day, to_grain, to_week
from cadence.operators.calendar import open_per_day, zero_filled_counts
from cadence.operators.calendar import running_total, calendar
from cadence.operators.means import bucket_mean
from cadence.operators.period import resolve_as_of, trailing_period
from cadence.operators.shape import size_buckets, top_k
from cadence.operators.trend import trend_line
from cadence.plans.common import REPO, all_repos, per_repo_card, with_repo
from cadence.sources.tables import Tables

DAY = 86400.0


def _prs(t: Tables) -> DataFrame:
    return with_repo(t.need("pull_requests"), t)


def _merged_base(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    """Merged in the period, both stamps present, no bots, no drafts."""
    p = trailing_period(_prs(t), "merged_at", days, as_of)
    return p.where(
        F.col("merged_at").isNotNull() & F.col("created_at").isNotNull() & not_in("author", d.bots) & not_draft()
    )


def _created_base(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    p = trailing_period(_prs(t), "created_at", days, as_of)
    return p.where(not_in("author", d.bots) & not_draft())


def pr_avg_lead_time(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Mean days from creation to merge, 2 dp; NULL for a repository without merges."""
    agg = _merged_base(t, days, as_of, d).groupBy(REPO).agg(
        round_half_up(F.avg(elapsed_seconds("created_at", "merged_at")) / DAY, 2).alias("avg_lead_time_days")
    )
    return per_repo_card(agg, t)


def pr_total(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    agg = _created_base(t, days, as_of, d).groupBy(REPO).agg(F.count(F.lit(1)).alias("total_prs"))
    return per_repo_card(agg, t, {"total_prs": 0})


def pr_total_comments(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    agg = _created_base(t, days, as_of, d).groupBy(REPO).agg(
        F.coalesce(F.sum("total_comments_count"), F.lit(0)).cast("bigint").alias("total_comments")
    )
    return per_repo_card(agg, t, {"total_comments": 0})


def pr_comments_per_pr(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Comments over PRs; a NULL comment count still counts in the denominator (A-04)."""
    agg = _created_base(t, days, as_of, d).groupBy(REPO).agg(
        round_half_up(F.sum("total_comments_count").cast("double") / F.count(F.lit(1)).cast("double"), 2).alias(
            "comments_per_pr"
        )
    )
    return per_repo_card(agg, t)


def pr_cards(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """The four cards side by side with the card rule: 0 or missing → NULL (P-24)."""
    out = (
        pr_avg_lead_time(t, days, as_of, d)
        .join(pr_total(t, days, as_of, d), REPO)
        .join(pr_total_comments(t, days, as_of, d), REPO)
        .join(pr_comments_per_pr(t, days, as_of, d), REPO)
    )
    return out.select(REPO, *[F.nullif(F.col(c), F.lit(0)).alias(c) for c in out.columns if c != REPO])


def pr_lead_time_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return bucket_mean(_merged_base(t, days, as_of, d), REPO, "merged_at", elapsed_seconds("created_at", "merged_at"), "week", DAY,
                       name="avg_lead_time_days")


def pr_lead_time_trend(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Least-squares line through the (rounded) weekly means, x = week ordinal;
    slope 0 for a single week (T-01). The ordinal is a window over the weekly
    aggregate (one row per week), partitioned by repository."""
    from pyspark.sql import Window

    weekly = pr_lead_time_weekly(t, days, as_of, d)
    pts = weekly.withColumn("x", F.row_number().over(Window.partitionBy(REPO).orderBy("week")))
    out = trend_line(pts, REPO, "x", "avg_lead_time_days", degenerate="zero", digits=2)
    return out.select(REPO, F.col("week").alias("date"), "trend_line")


def pr_merged_per_day(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Merged PRs per day (per Monday week from ``grain_switch_days``), gaps 0;
    drafts out, bots kept."""
    p = trailing_period(_prs(t), "merged_at", days, as_of, upper=True).where(
        F.col("merged_at").isNotNull() & not_draft()
    )
    return zero_filled_counts(p, all_repos(t), REPO, "merged_at", days, as_of, d.grain_switch_days)


def pr_new_per_day(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    p = trailing_period(_prs(t), "created_at", days, as_of, upper=True).where(not_draft())
    return zero_filled_counts(p, all_repos(t), REPO, "created_at", days, as_of, d.grain_switch_days)


def pr_open_per_day(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """PRs open on each day from the first creation day in the period to today.
    PRs created before the period are not counted (as in the original)."""
    p = trailing_period(_prs(t), "created_at", days, as_of).where(not_draft())
    return open_per_day(p, REPO, "created_at", "closed_at", as_of)


def pr_new_cumulative(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Running total of created PRs per day from the first day (no bot or draft filter)."""
    p = trailing_period(_prs(t), "created_at", days, as_of)
    daily = p.groupBy(REPO, to_day("created_at").alias("date")).agg(F.count(F.lit(1)).alias("daily_count"))
    bounds = daily.groupBy(REPO).agg(F.min("date").alias("__start"))
    cal = calendar(bounds, F.col("__start"), to_day(resolve_as_of(as_of)), 1, "date").select(REPO, "date")
    filled = cal.join(daily, [REPO, "date"], "left").withColumn(
        "daily_count", F.coalesce(F.col("daily_count"), F.lit(0))
    )
    return running_total(filled, REPO, "date", "daily_count").select(
        REPO, "date", F.col("cumulative_count").cast("bigint").alias("cumulative_count")
    )


def pr_size_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    p = trailing_period(_prs(t), "created_at", days, as_of).where(F.col("additions").isNotNull())
    return bucket_mean(p, REPO, "created_at", "additions", "week", name="avg_additions")


def pr_comments_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    p = trailing_period(_prs(t), "created_at", days, as_of)
    return bucket_mean(p, REPO, "created_at", "total_comments_count", "week", name="avg_comments")


def pr_comments_by_size_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Mean comments over mean additions per week (A-05); NULL when additions average 0."""
    p = trailing_period(_prs(t), "created_at", days, as_of)
    ratio = F.try_divide(F.avg("total_comments_count"), F.nullif(F.avg("additions"), F.lit(0.0)))
    return p.groupBy(REPO, to_week("created_at").alias("week")).agg(
        round_half_up(ratio, 2).alias("avg_comments_per_addition")
    )


def pr_size_distribution(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    p = trailing_period(_prs(t), "created_at", days, as_of).where(F.col("additions").isNotNull() & not_draft())
    return size_buckets(p, REPO, "additions", d.size_edges, d.size_labels, digits=0)


def pr_slowest(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS, k: int = 50) -> DataFrame:
    """The ``k`` longest lead times per repository; ties by PR number."""
    lead = round_half_up(elapsed_seconds("created_at", "merged_at") / DAY, 2)
    p = _merged_base(t, days, as_of, d).select(
        REPO, "title", lead.alias("lead_time_days"), "number", "created_at", "merged_at"
    )
    return top_k(p, REPO, [F.col("lead_time_days").desc(), F.col("number").asc()], k)


METRICS = {
    "pr_avg_lead_time": pr_avg_lead_time,
    "pr_total": pr_total,
    "pr_total_comments": pr_total_comments,
    "pr_comments_per_pr": pr_comments_per_pr,
    "pr_lead_time_weekly": pr_lead_time_weekly,
    "pr_lead_time_trend": pr_lead_time_trend,
    "pr_merged_per_day": pr_merged_per_day,
    "pr_open_per_day": pr_open_per_day,
    "pr_new_per_day": pr_new_per_day,
    "pr_new_cumulative": pr_new_cumulative,
    "pr_size_weekly": pr_size_weekly,
    "pr_comments_weekly": pr_comments_weekly,
    "pr_comments_by_size_weekly": pr_comments_by_size_weekly,
    "pr_size_distribution": pr_size_distribution,
    "pr_slowest": pr_slowest,
}
