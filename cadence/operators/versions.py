"""Module versions: numeric version order, per-major release summary (I-10),
latest major per module and the drift class of each use (J-06, P-15 … P-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.text import contains_any, first_int, split_part
from cadence.functions.predicates import not_relative_path
from cadence.functions.util import as_col

# --- fixed values: version text rules ---
MAJOR_PATTERN = r"^v?(\d+)\."
UP_TO_DATE, OUTDATED, UNKNOWN = "up-to-date", "outdated", "unknown"
# --- end of fixed values ---


def version_key(version) -> Column:
    """Numeric order of a version text: (major, minor, patch) after one leading
    'v'; a missing or empty part counts 0, a non-number sorts first."""
    v = F.regexp_replace(as_col(version), "^v", "")

    def part(i: int) -> Column:
        txt = F.split_part(v, F.lit("."), F.lit(i))
        return F.when(txt == "", F.lit(0).cast("bigint")).otherwise(txt.try_cast("bigint"))

    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def major_of(version) -> Column:
    """Major number of texts shaped ``v?N.``; NULL (skipped) otherwise."""
    return F.regexp_extract(as_col(version), MAJOR_PATTERN, 1).try_cast("int")


def release_summary(versions: DataFrame, module: str = "module_name", provider: str = "provider",
                    version: str = "version", published_at: str = "published_at") -> DataFrame:
    """Per (module, provider, major): first version in numeric order, its publish
    date, number of versions, last version (I-10).

    One sort aggregate with map-side reduction (``min_by`` / ``max_by`` on the order struct); ties in
    numeric order fall back to the text and then the date so the pick is total.
    Majors whose first version has no date are skipped, as are versions without
    ``N.``.
    """
    v = versions.select(
        F.col(module).alias("module_name"),
        F.col(provider).alias("provider"),
        F.col(version).alias("version"),
        F.col(published_at).cast("timestamp_ntz").alias("published_at"),
    ).where(major_of("version").isNotNull())
    order = F.struct(version_key("version").alias("k"), F.col("version"), F.col("published_at"))
    summary = v.groupBy("module_name", "provider", major_of("version").alias("major_version")).agg(
        F.min_by(F.struct("version", "published_at"), order).alias("__first"),
        F.count(F.lit(1)).alias("releases_count"),
        F.max_by(F.col("version"), order).alias("latest_version"),
    )
    return summary.where(F.col("__first.published_at").isNotNull()).select(
        "module_name",
        "provider",
        "major_version",
        F.col("__first.version").alias("first_release_version"),
        F.col("__first.published_at").alias("release_date"),
        F.col("releases_count").cast("bigint").alias("releases_count"),
        "latest_version",
    )


def latest_per_module(releases: DataFrame) -> DataFrame:
    """Newest major per module name (J-06). The original keys on the name only,
    so providers tie arbitrarily; we take the highest major, then the
    alphabetically last provider."""
    pick = F.struct("major_version", "provider")
    return releases.groupBy("module_name").agg(
        F.max_by(F.struct("latest_version", "major_version"), pick).alias("__l")
    ).select("module_name", F.col("__l.latest_version").alias("latest_version"),
             F.col("__l.major_version").alias("major_version"))


def drift_status(used_version: Column, latest_version: Column, latest_major: Column) -> Column:
    """unknown / up-to-date / outdated from the first number of the used
    constraint; a used major above the latest is unknown (P-18)."""
    used_major = first_int(used_version)
    return (
        F.when(used_version.isNull() | latest_version.isNull(), F.lit(UNKNOWN))
        .when(used_major == latest_major, F.lit(UP_TO_DATE))
        .when(used_major < latest_major, F.lit(OUTDATED))
        .otherwise(F.lit(UNKNOWN))
    )


def is_dx_module(module, markers) -> Column:
    return contains_any(module, markers)


def version_drift(uses: DataFrame, releases: DataFrame, markers, keep_all: bool = False) -> DataFrame:
    """Used vs latest version and drift status per DX module use.

    ``uses`` has (repository, module, file_path, version). The module name is
    the 2nd path part of the source. With ``keep_all`` every use is returned
    with an ``is_dx`` flag (for per-repository zero counts).
    """
    latest = latest_per_module(releases)
    counted = not_relative_path("module") & is_dx_module("module", markers)
    u = uses.withColumn("__name", split_part("module", "/", 2))
    if not keep_all:
        u = u.where(counted)
    j = u.join(latest, u["__name"] == latest["module_name"], "left")
    out = j.select(
        "repository",
        F.col("module").alias("module_name"),
        F.col("version").alias("used_version"),
        F.col("latest_version"),
        F.col("file_path"),
        drift_status(F.col("version"), F.col("latest_version"), F.col("major_version")).alias("drift_status"),
        *([counted.alias("is_dx")] if keep_all else []),
    )
    return out
