"""Adoption metrics: shared pipelines and modules per repository (no period)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import (
    DEFAULTS,
    DX_LIST_LABEL,
    DX_MODULE_LABEL,
    DX_PIPELINE_LABEL,
    NON_DX_LIST_LABEL,
    NON_DX_MODULE_LABEL,
    NON_DX_PIPELINE_LABEL,
    Defaults,
)
from cadence.functions import contains_any, not_in, not_relative_path, two_way_class
from cadence.operators.shape import first_per_key, percent_of
from cadence.operators.versions import OUTDATED, UNKNOWN, UP_TO_DATE, version_drift
from cadence.plans.common import REPO, with_repo
from cadence.sources.tables import Tables


def _workflow_per_name(t: Tables, d: Defaults) -> DataFrame:
    """One workflow per (repository, name): a DX pipeline first, then the
    lowest id (O-03; also used where the original picks arbitrarily, O-04)."""
    w = with_repo(t.need("workflows").where(not_in("name", d.excluded_workflows)), t)
    dx = contains_any("pipeline", [d.dx_pipeline_marker])
    order = [F.when(dx, F.lit(0)).otherwise(F.lit(1)), F.col("id")]
    return first_per_key(w, [REPO, "name"], order, ["pipeline"])


def adoption_pipelines(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    w = _workflow_per_name(t, d)
    cls = two_way_class("pipeline", [d.dx_pipeline_marker], DX_PIPELINE_LABEL, NON_DX_PIPELINE_LABEL)
    return w.groupBy(REPO, cls.alias("pipeline_type")).agg(F.count(F.lit(1)).alias("pipeline_count"))


def adoption_workflow_list(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    w = _workflow_per_name(t, d)
    cls = two_way_class("pipeline", [d.dx_pipeline_marker], DX_LIST_LABEL, NON_DX_LIST_LABEL)
    return w.select(REPO, F.col("name").alias("workflow_name"), cls.alias("pipeline_type"))


def _modules(t: Tables) -> DataFrame:
    return t.need("terraform_modules").where(not_relative_path("module"))


def adoption_modules(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    m = _modules(t).select(REPO, "module").distinct()
    cls = two_way_class("module", d.dx_module_markers, DX_MODULE_LABEL, NON_DX_MODULE_LABEL)
    return m.groupBy(REPO, cls.alias("module_type")).agg(F.count(F.lit(1)).alias("module_count"))


def adoption_module_list(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Module, class and one file path (the smallest; NULL paths last)."""
    m = first_per_key(_modules(t), [REPO, "module"], [F.col("file_path").isNull(), F.col("file_path")],
                      ["file_path"])
    cls = two_way_class("module", d.dx_module_markers, DX_LIST_LABEL, NON_DX_LIST_LABEL)
    return m.select(REPO, F.col("module").alias("module_name"), cls.alias("module_type"), "file_path")


def module_version_drift(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    return version_drift(t.need("terraform_modules"), t.need("terraform_registry_releases"), d.dx_module_markers)


def module_version_drift_summary(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Counts per drift status and total per repository, with the up-to-date
    share (H-03). Repositories with modules but no DX module get zeros."""
    u = version_drift(t.need("terraform_modules"), t.need("terraform_registry_releases"), d.dx_module_markers,
                      keep_all=True)
    dx = F.col("is_dx")
    s = F.col("drift_status")
    out = u.groupBy(REPO).agg(
        F.count_if(dx & (s == UP_TO_DATE)).alias("up_to_date"),
        F.count_if(dx & (s == OUTDATED)).alias("outdated"),
        F.count_if(dx & (s == UNKNOWN)).alias("unknown"),
        F.count_if(dx).alias("total"),
    )
    return out.withColumn("up_to_date_pct", percent_of(F.col("up_to_date"), F.col("total"), 0))


METRICS = {
    "adoption_pipelines": adoption_pipelines,
    "adoption_modules": adoption_modules,
    "adoption_workflow_list": adoption_workflow_list,
    "adoption_module_list": adoption_module_list,
    "module_version_drift": module_version_drift,
    "module_version_drift_summary": module_version_drift_summary,
}
