"""Review metrics, all repositories at once (anchor: ``as_of``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import elapsed_seconds, not_draft, not_in, round_half_up
from cadence.operators.means import bucket_mean
from cadence.operators.period import trailing_period
from cadence.operators.related import first_related, last_related
from cadence.plans.common import REPO, per_repo_card, with_repo
from cadence.sources.tables import Tables

HOUR = 3600.0


def _prs(t: Tables, ts: str, days: int, as_of, d: Defaults) -> DataFrame:
    p = trailing_period(with_repo(t.need("pull_requests"), t), ts, days, as_of)
    return p.where(not_in("author", d.bots) & not_draft())


def _with_first_review(p: DataFrame, t: Tables) -> DataFrame:
    return first_related(p, t.need("pull_request_reviews"), ("id", "pull_request_id"), "submitted_at",
                         name="first_review_at", prefilter=t.stored)


def _with_last_approval(p: DataFrame, t: Tables, nulls: str) -> DataFrame:
    return last_related(p, t.need("pull_request_reviews"), ("id", "pull_request_id"), "submitted_at",
                        where=F.col("state") == "APPROVED", nulls=nulls, name="last_approval_at", prefilter=t.stored)


def review_avg_time_to_first(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Mean hours from creation to the first review, PRs merged in the period."""
    p = _with_first_review(_prs(t, "merged_at", days, as_of, d), t)
    agg = p.groupBy(REPO).agg(
        round_half_up(F.avg(elapsed_seconds("created_at", "first_review_at")) / HOUR, 2).alias(
            "avg_hours_to_first_review"
        )
    )
    return per_repo_card(agg, t)


def review_time_to_first_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """The same per creation week; the period is on created_at here."""
    p = _with_first_review(_prs(t, "created_at", days, as_of, d), t)
    return bucket_mean(p, REPO, "created_at", elapsed_seconds("created_at", "first_review_at"), "week", HOUR, name="avg_hours_to_first_review")


def review_avg_time_to_merge(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS,
                             nulls: str = "reference") -> DataFrame:
    """Mean hours from the last approval to the merge (may be negative)."""
    p = _with_last_approval(_prs(t, "merged_at", days, as_of, d), t, nulls)
    agg = p.groupBy(REPO).agg(
        round_half_up(F.avg(elapsed_seconds("last_approval_at", "merged_at")) / HOUR, 2).alias("avg_hours_to_merge")
    )
    return per_repo_card(agg, t)


def review_time_to_merge_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS,
                                nulls: str = "reference") -> DataFrame:
    p = _with_last_approval(_prs(t, "merged_at", days, as_of, d), t, nulls)
    return bucket_mean(p, REPO, "merged_at", elapsed_seconds("last_approval_at", "merged_at"), "week", HOUR, name="avg_hours_to_merge")


def _reviews_in_period(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    r = trailing_period(with_repo(t.need("pull_request_reviews"), t), "submitted_at", days, as_of)
    return r.where(not_in("reviewer", d.bots))


def review_distribution(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Reviews, approvals and change requests per reviewer."""
    r = _reviews_in_period(t, days, as_of, d)
    return r.groupBy(REPO, "reviewer").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col("state") == "APPROVED").alias("approvals"),
        F.count_if(F.col("state") == "CHANGES_REQUESTED").alias("change_requests"),
    )


def review_matrix(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS,
                  drop_self: bool = False) -> DataFrame:
    """Reviews per (PR author, reviewer).

    Reviews are first counted per (PR, reviewer) — a partial aggregate, so a PR
    with a huge review thread is one row per reviewer before the join to PRs.
    ``drop_self`` removes author = reviewer pairs (done on the page originally).
    """
    r = _reviews_in_period(t, days, as_of, d)
    per_pr = r.groupBy(REPO, "pull_request_id", "reviewer").agg(F.count(F.lit(1)).alias("__n"))
    p = t.need("pull_requests").where(not_in("author", d.bots) & not_draft()).select(
        F.col("id").alias("pull_request_id"), "author"
    )
    m = per_pr.join(p, "pull_request_id", "inner")
    if drop_self:
        m = m.where(F.col("author") != F.col("reviewer"))
    return m.groupBy(REPO, "author", "reviewer").agg(F.sum("__n").cast("bigint").alias("review_count"))


METRICS = {
    "review_avg_time_to_first": review_avg_time_to_first,
    "review_time_to_first_weekly": review_time_to_first_weekly,
    "review_avg_time_to_merge": review_avg_time_to_merge,
    "review_time_to_merge_weekly": review_time_to_merge_weekly,
    "review_distribution": review_distribution,
    "review_matrix": review_matrix,
}
