"""Infrastructure-PR metrics over ``iac_pr_lead_times``, all repositories at once.

The period counts back from each repository's latest created-or-merged time
(A-12); ``as_of`` stands in for repositories without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, SUPERVISED_LABEL, UNSUPERVISED_LABEL, Defaults
from cadence.functions import elapsed_seconds, not_draft, round_half_up, to_day, to_week
from cadence.functions.predicates import since
from cadence.operators.calendar import daily_running_total
from cadence.operators.means import bucket_mean
from cadence.operators.membership import membership_counts, with_membership
from cadence.operators.period import latest_anchor, resolve_as_of, with_anchor
from cadence.operators.trend import ordinal_trend_line
from cadence.plans.common import REPO, all_repos
from cadence.sources.tables import Tables

DAY = 86400.0


def _iac(t: Tables) -> DataFrame:
    return t.need("iac_pr_lead_times").withColumnRenamed("repository_full_name", REPO)


def iac_anchor(t: Tables, as_of=None, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Latest of created / merged per repository, ``as_of`` when none."""
    latest = _iac(t).groupBy(REPO).agg(F.max(F.greatest("created_at", "merged_at")).alias("max_date"))
    names = all_repos(t).unionByName(_iac(t).select(REPO)).distinct()
    return names.join(latest, REPO, "left").select(
        REPO, F.coalesce(F.col("max_date"), resolve_as_of(as_of)).alias("max_date")
    )


def _in_period(t: Tables, ts: str, days: int, as_of, d: Defaults) -> DataFrame:
    """Rows whose ``ts`` lies in the period before the anchor of their repository, without the excluded title.

    The table is read for the anchors and for the rows. Where it is derived, both
    readings share the shuffles of the derivation as long as no filter
    reaches into one of them; so the conditions, which hold for few rows less
    than all, are one value beside the anchor (``coalesce`` keeps the optimizer
    from moving parts of it down or inferring others).
    """
    rows = with_anchor(_iac(t), latest_anchor(_iac(t), REPO, ["created_at", "merged_at"], as_of, "max_date"), REPO, "max_date")
    holds = (F.col("title") != d.excluded_title) & since(ts, F.col("max_date"), days) & F.col("created_at").isNotNull()
    return rows.where(F.coalesce(holds, F.lit(False)))


def _merged(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    return _in_period(t, "merged_at", days, as_of, d)


def _created(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    return _in_period(t, "created_at", days, as_of, d)


def iac_lead_time_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return bucket_mean(_merged(t, days, as_of, d), REPO, "merged_at", elapsed_seconds("created_at", "merged_at"), "week", DAY,
                       name="avg_lead_time_days")


def iac_lead_time_trend(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Least-squares line over single PRs, x = ordinal by creation day (ties by
    PR number), clamped at 0 (T-02)."""
    pts = _merged(t, days, as_of, d).select(
        REPO,
        "pr_number",
        to_day("created_at").alias("date"),
        (elapsed_seconds("created_at", "merged_at") / DAY).alias("lead_time_days"),
    )
    return ordinal_trend_line(pts, REPO, "date", "pr_number", "lead_time_days", digits=2, floor=0).drop("lead_time_days")


def _with_pr(t: Tables, df: DataFrame) -> DataFrame:
    """Left join to the PR of the same repository and number (J-03)."""
    p = t.need("pull_requests").select(
        F.col("repository_id").alias("__rid"), F.col("number").alias("__num"), "merged_by", F.col("draft")
    )
    return df.join(p, (df.repository_id == p.__rid) & (df.pr_number == p.__num), "left").drop("__rid", "__num")


def iac_supervised_cumulative(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Running daily total of supervised vs unsupervised PRs: supervised when the
    author or the merger is a team member (P-19); NULLs fall to unsupervised."""
    j = _with_pr(t, _created(t, days, as_of, d)).where(not_draft("draft"))
    j = with_membership(j, t.need("dx_team_members"), ["author", "merged_by"])
    cls = F.when(F.col("is_member_author") | F.col("is_member_merged_by"), F.lit(SUPERVISED_LABEL)).otherwise(
        F.lit(UNSUPERVISED_LABEL)
    )
    out = daily_running_total(j.withColumn("pr_type", cls), REPO, "created_at", "pr_type")
    return out.select(REPO, "run_date", "pr_type", F.col("cumulative_count").cast("bigint"))


def iac_count_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return _created(t, days, as_of, d).groupBy(REPO, to_week("created_at").alias("week")).agg(
        F.count(F.lit(1)).alias("pr_count")
    )


def iac_by_member(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Per team member — as author, or as merger other than the author — PRs,
    merged PRs and mean lead days (O-05, P-20, O-06, A-06, A-10)."""
    base = _with_pr(t, _created(t, days, as_of, d)).select(
        REPO, "pr_number", "author", "created_at", "merged_at", "merged_by"
    ).distinct()
    secs = F.when(F.col("merged_at").isNotNull(), elapsed_seconds("created_at", "merged_at"))
    return membership_counts(base, t.need("dx_team_members"), ["author", "merged_by"], REPO, [
        F.count(F.lit(1)).alias("total_prs"),
        F.count_if(F.col("merged_at").isNotNull()).alias("merged_prs"),
        round_half_up(F.avg(secs) / DAY, 2).alias("avg_lead_time_days"),
    ], name="reviewer")


METRICS = {
    "iac_lead_time_weekly": iac_lead_time_weekly,
    "iac_lead_time_trend": iac_lead_time_trend,
    "iac_supervised_cumulative": iac_supervised_cumulative,
    "iac_count_weekly": iac_count_weekly,
    "iac_by_member": iac_by_member,
}
