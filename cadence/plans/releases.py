"""Registry-release metrics over the per-major release summary (no period)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import to_date_text, to_month_text
from cadence.sources.tables import Tables


def _rel(t: Tables) -> DataFrame:
    return t.need("terraform_registry_releases")


def release_stats(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Modules, majors, releases, oldest and newest date as 'yyyy-MM-dd' (P-22)."""
    return _rel(t).agg(
        F.countDistinct("module_name").alias("total_modules"),
        F.count(F.lit(1)).alias("total_major_versions"),
        F.coalesce(F.sum("releases_count"), F.lit(0)).cast("bigint").alias("total_releases"),
        to_date_text(F.min("release_date")).alias("oldest_release"),
        to_date_text(F.max("release_date")).alias("newest_release"),
    )


def release_module_summary(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Per module and provider: majors, releases, first / last major start date,
    latest major and 'vN (count)' labels in major order (A-13). The label list
    is gathered per (module, provider) — one entry per major — and sorted."""
    label = F.concat(
        F.lit("v"), F.col("major_version").cast("string"), F.lit(" ("),
        F.coalesce(F.col("releases_count").cast("string"), F.lit("?")), F.lit(")"),
    )
    out = _rel(t).groupBy("module_name", "provider").agg(
        F.count(F.lit(1)).alias("major_versions_count"),
        F.coalesce(F.sum("releases_count"), F.lit(0)).cast("bigint").alias("total_releases"),
        F.to_date(F.min("release_date")).alias("first_release_date"),
        F.to_date(F.max("release_date")).alias("last_release_date"),
        F.max("major_version").alias("latest_major"),
        F.array_sort(F.collect_list(F.struct(F.col("major_version").alias("m"), label.alias("l")))).alias("__v"),
    )
    return out.withColumn("versions_detail", F.array_join(F.transform("__v", lambda x: x["l"]), ", ")).drop("__v")


def release_timeline(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    r = _rel(t).where(F.col("release_date").isNotNull())
    return r.groupBy(to_month_text("release_date").alias("month")).agg(
        F.count(F.lit(1)).alias("major_versions_introduced"),
        F.coalesce(F.sum("releases_count"), F.lit(0)).cast("bigint").alias("total_releases"),
    )


METRICS = {
    "release_stats": release_stats,
    "release_module_summary": release_module_summary,
    "release_timeline": release_timeline,
}
