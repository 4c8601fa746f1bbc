"""The ingest jobs over the driver's tables (registered queries): stored tables and landed batches that overlap.

A batch brings changed versions of stored rows, new rows and rows that land
twice, so each write rule decides something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import lit_ntz
from cadence.plans import ingest
from cadence.sources.tables import Tables

# --- fixed values: boundaries of the scenarios ---
STORED_BEFORE = "1998-01-01"
SINCE = "1996-01-01"
BOT_REVIEWER = "rev3"
KNOWN_REPOSITORIES = 20
RUN_SINCE_DAYS = 12
# --- end of fixed values ---


def import_pull_requests(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-01: PRs created before 1998 are stored; all PRs land again with new titles, changed since 1996 or not."""
    p = t.need("pull_requests")
    landed = p.withColumn("updated_at", F.coalesce("closed_at", "created_at")).withColumn(
        "draft_flag", F.col("draft") == 1).withColumn("title", F.concat(F.lit("new "), F.col("title"))).withColumn(
        "author", F.lit("someone")).withColumn("arrival", F.col("updated_at"))
    return ingest.import_pull_requests(p.where(F.col("created_at") < lit_ntz(STORED_BEFORE)), landed, lit_ntz(SINCE))


def backfill_pr_details(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-02, K-07: PRs without draft flag lack their details; every line item lands as a detail, the last line counts."""
    p = t.need("pull_requests")
    stored = p.withColumn("additions", F.when(F.col("draft").isNotNull(), F.col("additions")))
    details = t.raw.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey").join(
        p.select("repository_id", "number"), F.col("l_orderkey") == F.col("number")).select(
        "repository_id", "number", F.col("l_quantity").cast("bigint").alias("additions"),
        F.concat(F.lit("rev"), (F.col("l_suppkey") % 20).cast("string")).alias("merged_by"),
        F.col("l_linenumber").cast("bigint").alias("comments"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit(10).cast("bigint")).alias("review_comments"),
        F.struct("l_linenumber", "l_quantity", "l_suppkey").alias("arrival"))
    return ingest.backfill_pr_details(stored, details, lit_ntz(SINCE), order="arrival")


def import_reviews(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-03: reviews before 1998 are stored; all land again approved, without those of bots and of unmerged PRs."""
    li = t.raw.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_shipdate")
    reviews = li.select(
        "l_suppkey", "l_partkey",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("pull_request_id"),
        F.when(F.col("l_suppkey") % 20 != 7, F.concat(F.lit("rev"), (F.col("l_suppkey") % 20).cast("string"))).alias("reviewer"),
        F.col("l_returnflag").alias("state"), F.col("l_shipdate").alias("submitted_at"))
    landed = reviews.withColumn("state", F.lit("APPROVED")).withColumn("arrival", F.struct("submitted_at", "l_suppkey", "l_partkey"))
    stored = reviews.where(F.col("submitted_at") < lit_ntz(STORED_BEFORE)).drop("l_suppkey", "l_partkey")
    return ingest.import_reviews(stored, landed, t.need("pull_requests"),
                                 lit_ntz(SINCE), d.with_(bots=(BOT_REVIEWER,)))


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    runs, workflows = t.need("workflow_runs"), t.need("workflows").where(F.col("id") % 3 != 0)
    since = runs.agg(F.max("created_at") - F.make_dt_interval(F.lit(RUN_SINCE_DAYS))).scalar()
    landed = runs.withColumn("conclusion", F.lit("landed")).withColumn(
        "run_name", F.when(F.col("workflow_id") % 2 == 0, F.concat(F.lit("run "), F.col("workflow_id").cast("string")))).withColumn(
        "arrival", F.struct("created_at", "id"))
    stored = runs.where(F.col("id") % 2 == 0)
    return ingest.import_workflow_runs(stored, workflows, landed, since)


def import_workflow_runs(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-05: half of the runs are stored; those of the last days land with a new conclusion."""
    return _runs(t)[0]


def import_workflow_stubs(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-05: a third of the workflows is unknown and becomes stubs named after a run, or 'unknown'."""
    return _runs(t)[1]


def _member_commits(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.need("commits")
    stored = c.where(F.col("committer_date") < lit_ntz(STORED_BEFORE))
    landed = c.withColumn("arrival", F.struct("committer_date", "sha")).withColumn("author", F.lit("landed"))
    known = t.need("repositories").where(F.col("id") < KNOWN_REPOSITORIES)
    return ingest.import_member_commits(stored, landed, known)


def import_member_commits(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-07: commits before 1998 are stored, all land again; those of unknown repositories come with the repository."""
    return _member_commits(t)[0]


def created_repositories(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """K-08: repositories with those that the landed commits create."""
    return _member_commits(t)[1]


def import_code_search(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-09, K-03, K-05: hits of two queries are stored; new hits of one replace its rows, without path some of them."""
    docs = t.raw.documents.select("doc_id", "source")
    hit = F.concat(F.lit("org/"), F.col("source"))
    stored = docs.select(F.when(F.col("doc_id") % 2 == 0, "first").otherwise("second").alias("query"),
                         hit.alias("repository_full_name"), F.col("doc_id").cast("string").alias("path"))
    landed = docs.select(F.when(F.col("doc_id") % 11 != 0, hit).alias("repository_full_name"),
                         F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 50).cast("string")).alias("path"),
                         F.col("doc_id").alias("arrival"))
    return ingest.import_code_search(stored, landed, "first")


def import_terraform_modules(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-11: a scan of some repositories replaces their modules; empty paths and versions become NULL."""
    m = t.need("terraform_modules")
    scanned = t.raw.part.where(F.col("p_brand").contains("#2")).select(
        F.col("p_brand").alias("repository"), F.lower("p_type").alias("source"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("filePath"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("~> "), F.col("p_size").cast("string"))).alias("version"),
        F.col("p_partkey").alias("arrival"))
    return ingest.import_terraform_modules(m, scanned)


JOBS = {f.__name__: f for f in (
    import_pull_requests, backfill_pr_details, import_reviews, import_workflow_runs, import_workflow_stubs,
    import_member_commits, created_repositories, import_code_search, import_terraform_modules)}
