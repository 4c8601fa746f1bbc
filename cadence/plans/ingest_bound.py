"""Ingest and merge operators run on the bound tables (registered queries).

Each builds a realistic target / batch pair from the whole tables — an older
snapshot and a newer batch that overlap in time — and applies one write rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import lit_ntz
from cadence.operators.merge import insert_ignore, replace_by_key, upsert
from cadence.plans.ingest import PR_UPDATABLE
from cadence.sources.tables import Tables

# --- fixed values: snapshot boundaries of the merge scenarios ---
SNAPSHOT_END = "1999-01-01"
BATCH_START = "1998-06-01"
# --- end of fixed values ---


def iac_lead_times_job(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-06 over all commits and the PRs that they point to."""
    return t.need("iac_pr_lead_times")


def commits_insert_ignore(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """K-02: stored commits up to the snapshot end + a batch from the batch
    start; a sha already stored is ignored, the first batch row of a sha wins."""
    c = t.need("commits")
    target = c.where(F.col("committer_date") < lit_ntz(SNAPSHOT_END))
    batch = c.where(F.col("committer_date") >= lit_ntz(BATCH_START))
    return insert_ignore(target, batch, ["sha"], ["committer_date", "repository_id", "author"])


def pr_upsert(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """K-01: stored PRs created before the snapshot end; each review of a newer
    PR arrives as a new version of it (ordered by review time, reviewer,
    state). Title, closed / merged time and draft take the last version;
    author and creation time stay as first seen."""
    p = t.need("pull_requests")
    target = p.where(F.col("created_at") < lit_ntz(SNAPSHOT_END))
    r = t.need("pull_request_reviews").select(
        F.col("pull_request_id").alias("id"), "reviewer", "state", "submitted_at"
    )
    newer = p.where(F.col("created_at") >= lit_ntz(BATCH_START))
    batch = r.join(newer, "id", "inner").select(
        "id", "repository_id", "number",
        F.concat(F.col("title"), F.lit(" / "), F.col("reviewer")).alias("title"),
        F.col("reviewer").alias("author"), "merged_by", "created_at",
        F.col("submitted_at").alias("merged_at"), F.col("submitted_at").alias("closed_at"),
        "additions", "total_comments_count",
        F.when(F.col("state") == "APPROVED", 0).otherwise(1).alias("draft"),
        F.struct("submitted_at", "reviewer", "state").alias("__arrival"),
    )
    return upsert(target, batch, ["id"], "__arrival", PR_UPDATABLE)


def modules_replace_by_key(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """K-04: a new scan of some repositories, of their modules with small
    constraints, replaces all their stored rows; other repositories keep theirs."""
    m = t.need("terraform_modules")
    batch = m.where(F.col("version").startswith("~> 1") & F.col("repository").contains("#1")).select(
        "repository", "module", "file_path", F.concat(F.lit("~> 9."), F.lit("0")).alias("version")
    )
    return replace_by_key(m, batch, ["repository"])


def extract_usages_job(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-08 over the pages (usages of shared workflows, first ref per file)."""
    return t.need("dx_pipeline_usages")


def release_summary_job(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-10 over the registry versions (first / latest version per major)."""
    return t.need("terraform_registry_releases")


JOBS = {
    "iac_lead_times": iac_lead_times_job,
    "insert_ignore": commits_insert_ignore,
    "upsert": pr_upsert,
    "replace_by_key": modules_replace_by_key,
    "extract_usages": extract_usages_job,
    "release_summary": release_summary_job,
}
