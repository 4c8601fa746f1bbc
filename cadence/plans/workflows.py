"""CI workflow metrics, all repositories at once.

The period counts back from each repository's latest run (A-12), not from
``as_of``; ``as_of`` only stands in for repositories without runs. The anchor
is a one-row-per-repository aggregate joined to the runs, so every metric is
one job for all repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import (
    contains_any,
    elapsed_seconds,
    not_in,
    prefixed_label,
    round_half_up,
    to_week,
    trimmed_eq,
    trimmed_in,
    two_way_class,
)
from cadence.operators.calendar import daily_running_total
from cadence.functions.predicates import since
from cadence.operators.period import latest_anchor, resolve_as_of, trailing_period
from cadence.operators.shape import pivot_forward_fill, rate_by
from cadence.plans.common import REPO, all_repos, per_repo_card, with_repo
from cadence.sources.slices import sliced_period
from cadence.sources.tables import Tables

MINUTE = 60.0


def _latest(t: Tables, as_of) -> DataFrame:
    """Latest run start per repository id: one row a repository leaves each task, names come later."""
    runs = t.need("workflow_runs").where(F.col("repository_id").isNotNull())
    return latest_anchor(runs, "repository_id", "created_at", as_of, "max_date")


def wf_anchor(t: Tables, as_of=None, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Latest run start per repository, ``as_of`` for repositories without runs."""
    latest = with_repo(_latest(t, as_of), t).groupBy(REPO).agg(F.max("max_date").alias("max_date"))
    return all_repos(t).join(latest, REPO, "left").select(
        REPO, F.coalesce(F.col("max_date"), resolve_as_of(as_of)).alias("max_date")
    )


def _anchored(t: Tables, as_of, ts: str, days: int) -> DataFrame:
    """Runs of the period with workflow, repository and anchor.

    No repository's period begins before the earliest anchor minus ``days``:
    that bound, a scalar, is a filter on the scan of the runs, so files of older
    runs are skipped; the repository's own period is tested on what is left.
    Runs that are stored in slices are pruned by repository and month instead,
    so one stale repository opens its own old files only.
    """
    stored = t.sliced.get(("workflow_runs", ts))
    if stored is not None:
        rows = sliced_period(stored, days, resolve_as_of(as_of), upper=stored.anchor != ts)
    else:
        latest = _latest(t, as_of)
        floor = latest.agg(F.min("max_date")).scalar()
        runs = t.need("workflow_runs").where(F.col(ts) >= floor - F.make_dt_interval(F.lit(days)))
        rows = runs.join(latest, "repository_id", "inner").where(since(ts, F.col("max_date"), days))
    w = t.need("workflows").select(F.col("id").alias("workflow_id"), "name", "pipeline")
    return with_repo(rows.join(w, "workflow_id", "inner"), t)


def _dx_flag(d: Defaults):
    return contains_any("pipeline", [d.dx_pipeline_marker])


def _label(d: Defaults):
    return prefixed_label(_dx_flag(d), "DX ", "name").alias("workflow_name")


def wf_deployments_weekly(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Successful deploy-like runs per Monday week."""
    r = trailing_period(_anchored(t, as_of, "created_at", days), "created_at", days, anchor="max_date").where(
        contains_any(F.lower("name"), d.deploy_words)
        & trimmed_eq("conclusion", "success")
        & (F.col("name") != d.labeler_workflow)
    )
    return r.groupBy(REPO, to_week("created_at").cast("timestamp_ntz").alias("run_week")).agg(
        F.count(F.lit(1)).alias("weekly_deployment_count")
    )


def _cumulative_input(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    r = trailing_period(_anchored(t, as_of, "created_at", days), "created_at", days, anchor="max_date").where(
        not_in("name", d.excluded_workflows)
    )
    return r.withColumn("pipeline_type", two_way_class("pipeline", [d.dx_pipeline_marker],
                                                       d.dx_pipeline_label, d.non_dx_pipeline_label))


def wf_dx_runs_cumulative(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Running daily total of runs, DX vs non-DX pipelines."""
    out = daily_running_total(_cumulative_input(t, days, as_of, d), REPO, "created_at", "pipeline_type")
    return out.select(REPO, "run_date", "pipeline_type", F.col("cumulative_count").cast("bigint"))


def wf_dx_runs_cumulative_wide(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Wide chart form: one column per series, gaps carried forward (H-01, H-02)."""
    long = wf_dx_runs_cumulative(t, days, as_of, d)
    return pivot_forward_fill(long, REPO, "run_date", "pipeline_type", "cumulative_count",
                              {d.dx_pipeline_label: "dx", d.non_dx_pipeline_label: "non_dx"})


def wf_failures(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    r = trailing_period(_anchored(t, as_of, "created_at", days), "created_at", days, anchor="max_date").where(
        trimmed_eq("conclusion", "failure") & not_in("name", d.excluded_workflows)
    )
    return r.groupBy(REPO, _label(d)).agg(F.count(F.lit(1)).alias("failed_runs"))


def _completed_ok(t: Tables, days: int, as_of, d: Defaults) -> DataFrame:
    """Completed successful runs updated within [anchor − days, anchor] (F-03)."""
    r = trailing_period(_anchored(t, as_of, "updated_at", days), "updated_at", days, anchor="max_date", upper=True)
    return r.where(
        (F.col("status") == "completed") & trimmed_eq("conclusion", "success") & not_in("name", d.excluded_workflows)
    )


def wf_durations(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Mean minutes, run count and total minutes per (prefixed) workflow — one
    aggregate that the three duration views project from."""
    r = _completed_ok(t, days, as_of, d).withColumn("__s", elapsed_seconds("created_at", "updated_at"))
    return r.groupBy(REPO, _label(d)).agg(
        (F.avg("__s") / MINUTE).alias("average_duration_minutes"),
        F.count(F.lit(1)).alias("run_count"),
        (F.sum("__s") / MINUTE).alias("cumulative_duration_minutes"),
    )


def wf_avg_duration(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return wf_durations(t, days, as_of, d).select(REPO, "workflow_name", "average_duration_minutes")


def wf_run_count(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return wf_durations(t, days, as_of, d).select(REPO, "workflow_name", "run_count")


def wf_total_duration(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return wf_durations(t, days, as_of, d).select(REPO, "workflow_name", "cumulative_duration_minutes")


def _infra(t: Tables, days: int, as_of, d: Defaults, file_name: str) -> DataFrame:
    r = trailing_period(_anchored(t, as_of, "created_at", days), "created_at", days, anchor="max_date", upper=True).where(
        (F.col("status") == "completed")
        & F.col("pipeline").contains(file_name)
        & (F.col("name") != d.labeler_workflow)
    )
    return r.select(
        REPO,
        F.col("created_at").alias("run_timestamp"),
        (elapsed_seconds("created_at", "updated_at") / MINUTE).alias("duration_minutes"),
    )


def wf_infra_plan_duration(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return _infra(t, days, as_of, d, d.infra_plan_file)


def wf_infra_apply_duration(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    return _infra(t, days, as_of, d, d.infra_apply_file)


def wf_success_ratio(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Runs, successes, failures and success % per workflow name (not prefixed)."""
    r = trailing_period(_anchored(t, as_of, "created_at", days), "created_at", days, anchor="max_date").where(
        trimmed_in("conclusion", ["success", "failure"]) & not_in("name", d.excluded_workflows)
    )
    out = rate_by(r, [REPO, F.col("name").alias("workflow_name")], trimmed_eq("conclusion", "success"),
                  trimmed_eq("conclusion", "failure"))
    return out


def wf_summary(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """Count, mean and total minutes and first start of the completed
    successful runs; one row per repository (count 0 when none)."""
    r = _completed_ok(t, days, as_of, d).withColumn("__s", elapsed_seconds("created_at", "updated_at"))
    agg = r.groupBy(REPO).agg(
        F.count(F.lit(1)).cast("int").alias("total_pipelines"),
        (F.avg("__s") / MINUTE).alias("avg_duration_minutes"),
        (F.sum("__s") / MINUTE).alias("total_duration_minutes"),
        F.min("created_at").alias("first_pipeline_date"),
    )
    return per_repo_card(agg, t, {"total_pipelines": 0})


METRICS = {
    "wf_deployments_weekly": wf_deployments_weekly,
    "wf_dx_runs_cumulative": wf_dx_runs_cumulative,
    "wf_failures": wf_failures,
    "wf_avg_duration": wf_avg_duration,
    "wf_run_count": wf_run_count,
    "wf_total_duration": wf_total_duration,
    "wf_infra_plan_duration": wf_infra_plan_duration,
    "wf_infra_apply_duration": wf_infra_apply_duration,
    "wf_success_ratio": wf_success_ratio,
    "wf_summary": wf_summary,
}
