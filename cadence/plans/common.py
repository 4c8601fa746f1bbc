"""Shared pieces of the metric plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.sources.tables import Tables

REPO = "repository"


def repos(t: Tables) -> DataFrame:
    """Repository dimension as (repository_id, repository)."""
    return t.need("repositories").select(F.col("id").alias("repository_id"), F.col("full_name").alias(REPO))


def with_repo(df: DataFrame, t: Tables, key: str = "repository_id") -> DataFrame:
    """Inner join facts to their repository (J-01); orphans drop.

    The dimension is small in practice, but no broadcast hint is given: the
    planner (and AQE at run time) broadcasts it from its measured size and
    falls back to a shuffle join when it is not small.
    """
    r = repos(t).withColumnRenamed("repository_id", key)
    return df.join(r, key, "inner")


def all_repos(t: Tables) -> DataFrame:
    return repos(t).select(REPO).distinct()


def per_repo_card(agg: DataFrame, t: Tables, fill: dict | None = None) -> DataFrame:
    """One row per repository, also for repositories without facts (A-17):
    ``fill`` gives the value of an empty aggregate (0 for counts, NULL for
    averages)."""
    out = all_repos(t).join(agg, REPO, "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)).cast(agg.schema[c].dataType))
    return out
