"""Team metrics: team vs others on a repository's PRs, member commits outside
own repositories, shared-pipeline adoption.

The original fixes one organization and one repository; here the PR metrics
run for every repository and the commit metrics for every organization (the
owner part of the repository name) in one pass. Passing ``org`` applies the
original single-organization predicates instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import not_draft, split_part, to_day, to_grain
from cadence.operators.calendar import stepped_week_calendar
from cadence.operators.membership import member_names, membership_split
from cadence.operators.period import trailing_period
from cadence.plans.common import REPO, all_repos, with_repo
from cadence.sources.tables import Tables


def team_pr_split(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS,
                  complete_calendar: bool = False) -> DataFrame:
    """Per day (per Monday week from the grain switch): PRs by team members and
    by others, gaps 0 (C-03, J-08). A NULL author counts in neither column.

    Membership is a left join to the team table (a flag), so both IN and NOT IN
    are one aggregate."""
    p = trailing_period(with_repo(t.need("pull_requests"), t), "created_at", days, as_of).where(not_draft())
    grain = to_grain("created_at", days, d.grain_switch_days).alias("date")
    counts = membership_split(p, t.need("dx_team_members"), "author", [REPO, grain], inside="dx_pr", outside="non_dx_pr")
    cal = stepped_week_calendar(all_repos(t), days, as_of, d.grain_switch_days, "date", complete_calendar)
    return cal.join(counts, [REPO, "date"], "left").select(
        REPO,
        "date",
        F.coalesce(F.col("dx_pr"), F.lit(0)).cast("bigint").alias("dx_pr"),
        F.coalesce(F.col("non_dx_pr"), F.lit(0)).cast("bigint").alias("non_dx_pr"),
    )


def team_pr_table(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Author and creation time of the PRs in the period (newest first when shown)."""
    p = trailing_period(with_repo(t.need("pull_requests"), t), "created_at", days, as_of).where(not_draft())
    return p.select(REPO, "author", "created_at")


def _member_commits(t: Tables, days: int, as_of) -> DataFrame:
    c = trailing_period(t.need("commits"), "committer_date", days, as_of)
    c = c.join(member_names(t.need("dx_team_members")), F.col("author") == F.col("__member"), "left_semi")
    return c.withColumn("organization", split_part("repository_full_name", "/", 1))


def team_commits_daily(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS,
                       org: str | None = None) -> DataFrame:
    """Member commits per day and member outside the own repositories (F-11)."""
    name = F.col("repository_full_name")
    c = _member_commits(t, days, as_of).where(
        ~name.rlike(d.own_repo_pattern) & ~name.contains(d.excluded_repo_substring)
    )
    if org is not None:
        c = c.where(name.rlike(org))
    return c.groupBy("organization", to_day("committer_date").alias("committer_date"),
                     F.col("author").alias("member_name")).agg(F.count(F.lit(1)).alias("repository_commits"))


def team_commits_by_repo(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS,
                         org: str | None = None) -> DataFrame:
    """Member commits per repository of the organization, minus the shared-tool
    and terraform repositories (F-12)."""
    name = F.col("repository_full_name")
    owner = F.lit(org) if org is not None else F.col("organization")
    c = _member_commits(t, days, as_of).where(
        name.startswith(F.concat(owner, F.lit("/")))
        & ~name.contains(F.concat(owner, F.lit("-"), F.lit(d.dx_repo)))
        & ~name.startswith(F.concat(owner, F.lit("/terraform")))
    )
    return c.groupBy("organization", F.col("author").alias("member_name"), name.alias("full_name")).agg(
        F.count(F.lit(1)).alias("repository_commits")
    )


def adopting_repositories(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Repositories found by the adoption code search, minus the tool's own."""
    c = t.need("code_search_results").where(
        (F.col("query") == d.code_search_query) & ~F.col("repository_full_name").contains(d.adoption_excluded_substring)
    )
    return c.select(F.col("repository_full_name").alias("repository")).distinct()


def shared_pipeline_usage(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Repositories per shared workflow (exact distinct count, A-09)."""
    u = t.need("dx_pipeline_usages")
    return u.groupBy(F.col("dx_workflow").alias("dx_path")).agg(
        F.countDistinct("repository").alias("repository_count")
    )


METRICS = {
    "team_pr_split": team_pr_split,
    "team_commits_daily": team_commits_daily,
    "team_pr_table": team_pr_table,
    "team_commits_by_repo": team_commits_by_repo,
}
STATIC = {
    "adopting_repositories": adopting_repositories,
    "shared_pipeline_usage": shared_pipeline_usage,
}
