"""Named queries over the driver's tables: key → callable(spark, sf_dir).

Each callable binds the stored tables to the driver's parquet tables (lazy
views), picks the binding's stand-ins (bots, team, as-of) and runs one metric
or operator over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.sources.bound import bind, bound_as_of, bound_defaults
from cadence.plans.periods import CALENDAR_DAYS, IAC_DAYS, MID_AS_OF, MID_DAYS, PR_DAYS, REVIEW_DAYS, TEAM_DAYS, WORKFLOW_DAYS

QueryFn = Callable[[SparkSession, str], DataFrame]


def _metric(fn, days: int | None = None, anchored: bool = True, **kw) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = bind(spark, sf_dir)
        args = dict(kw)
        if days is not None:
            args["days"] = days
        if anchored:
            args["as_of"] = bound_as_of(t)
        return fn(t, d=bound_defaults(), **args)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _events_running_total(t, d=None, **_):
    """Running daily total of events per event type (A-16, W-04) on ``events``."""
    from cadence.operators.calendar import daily_running_total

    ev = t.raw.events
    return daily_running_total(ev, "event_type", "ts").select(
        "event_type", "run_date", F.col("cumulative_count").cast("bigint").alias("cumulative_count")
    )


def _pipeline_share(t, d=None, **_):
    """Share of each pipeline class in its repository's workflows (H-04)."""
    from cadence.operators.shape import class_share
    from cadence.plans import adoption

    return class_share(adoption.METRICS["adoption_pipelines"](t, d=d), "repository", "pipeline_count", digits=1)


def queries() -> dict[str, QueryFn]:
    from cadence.plans import pull_requests as pr
    from cadence.plans import reviews as rv
    from cadence.plans import adoption, iac, ingest_bound, ingest_keys, operator_keys, releases, team, tracker
    from cadence.plans import workflows as wf

    q: dict[str, QueryFn] = {}
    for name, fn in pr.METRICS.items():
        q[name] = _metric(fn, PR_DAYS)
    for name, fn in rv.METRICS.items():
        q[name] = _metric(fn, REVIEW_DAYS)
    q["wf_anchor"] = _metric(wf.wf_anchor)
    for name, fn in wf.METRICS.items():
        q[name] = _metric(fn, WORKFLOW_DAYS)
    q["iac_anchor"] = _metric(iac.iac_anchor)
    for name, fn in iac.METRICS.items():
        q[name] = _metric(fn, IAC_DAYS)
    for name, fn in adoption.METRICS.items():
        q[name] = _metric(fn, anchored=False)
    for name, fn in team.METRICS.items():
        q[name] = _metric(fn, TEAM_DAYS)
    for name, fn in {**team.STATIC, **tracker.METRICS, **releases.METRICS}.items():
        q[name] = _metric(fn, anchored=False)
    # composite operators exposed on their own
    q["pivot_forward_fill"] = _metric(wf.wf_dx_runs_cumulative_wide, WORKFLOW_DAYS)
    q["zero_filled_counts"] = _metric(pr.pr_new_per_day, CALENDAR_DAYS)
    q["running_total"] = _metric(_events_running_total, anchored=False)
    # forms that the dashboards show beside the metrics, and other periods of some of them
    q["pr_cards"] = _metric(pr.pr_cards, PR_DAYS)
    q["adoption_pipeline_share"] = _metric(_pipeline_share, anchored=False)
    for name, fn in (("pr_total", pr.pr_total), ("pr_new_per_day", pr.pr_new_per_day)):
        q[f"{name}_mid"] = _metric(fn, MID_DAYS, anchored=False, as_of=MID_AS_OF)
    q["team_commits_daily_mid"] = _metric(team.METRICS["team_commits_daily"], MID_DAYS, anchored=False, as_of=MID_AS_OF)
    q["team_pr_split_daily"] = _metric(team.METRICS["team_pr_split"], CALENDAR_DAYS)
    # ingest jobs and write rules
    for name, fn in ingest_keys.JOBS.items():
        q[name] = _metric(fn, anchored=False)
    for name, fn in ingest_bound.JOBS.items():
        q[name] = _metric(fn, anchored=False)
    for name, fn in operator_keys.STATIC.items():
        q[name] = _metric(fn, anchored=False)
    for name, fn in operator_keys.PERIODIC.items():
        q[name] = _metric(fn, PR_DAYS)
    return q
