"""Ingest jobs: landed payloads → next snapshot of each stored table (I-01 … I-12).

Each job is a function of DataFrames (the stored table and the landed batch)
returning the new table; writing it is the caller's choice (a new snapshot
folder, or a partition overwrite). Every job handles all repositories at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import elapsed_seconds, not_in, round_half_up
from cadence.operators.merge import ensure_rows, insert_ignore, replace_by_key, update_found, upsert
from cadence.sources.landed import decode_base64

PR_UPDATABLE = ["title", "closed_at", "merged_at", "draft"]
RUN_UPDATABLE = ["conclusion", "status", "updated_at"]
WORKFLOW_UPDATABLE = ["name", "pipeline"]
REVIEW_UPDATABLE = ["state", "submitted_at"]
IAC_UPDATABLE = ["title", "merged_at", "lead_time_days", "target_authors"]
RELEASE_UPDATABLE = ["releases_count", "latest_version"]


def import_pull_requests(target: DataFrame, landed: DataFrame, since, order="arrival") -> DataFrame:
    """I-01: PRs updated since ``since``; draft flag → 0/1; upsert updating
    title, closed / merged times and draft only (author and creation time stay
    as first seen)."""
    b = landed.where(F.col("updated_at") >= F.lit(since)).select(
        *[c for c in target.columns if c not in ("draft",)],
        F.when(F.col("draft_flag"), 1).otherwise(0).alias("draft"),
        order,
    )
    return upsert(target, b, ["repository_id", "number"], order, PR_UPDATABLE)


def backfill_pr_details(target: DataFrame, details: DataFrame, since, order=None) -> DataFrame:
    """I-02: rows created since ``since`` with no additions or no comments get
    additions, merger and comments + review comments (NULL as 0); of details
    landed twice the last by ``order`` counts."""
    need = target.where(
        (F.col("additions").isNull() | F.col("total_comments_count").isNull()) & (F.col("created_at") >= F.lit(since))
    ).select("repository_id", "number")
    d = details.join(need, ["repository_id", "number"], "left_semi").select(
        "repository_id", "number", "additions", "merged_by",
        (F.coalesce("comments", F.lit(0)) + F.coalesce("review_comments", F.lit(0))).alias("total_comments_count"),
        *([] if order is None else [order]),
    )
    return update_found(target, d, ["repository_id", "number"], ["additions", "merged_by", "total_comments_count"], order)


def import_reviews(target: DataFrame, landed: DataFrame, prs: DataFrame, since, d: Defaults = DEFAULTS,
                   order="arrival") -> DataFrame:
    """I-03: reviews of PRs merged and created since; no NULL reviewer, no bots;
    upsert updating state and time. All reviews are taken (no 100-per-PR cap)."""
    merged = prs.where(F.col("merged_at").isNotNull() & (F.col("created_at") >= F.lit(since))).select(
        F.col("id").alias("pull_request_id")
    )
    b = landed.join(merged, "pull_request_id", "left_semi").where(
        F.col("reviewer").isNotNull() & not_in("reviewer", d.bots)
    )
    return upsert(target, b, ["id"], order, REVIEW_UPDATABLE)


def import_workflows(target: DataFrame, landed: DataFrame, order="arrival") -> DataFrame:
    """I-04: decode the workflow file, drop ``#`` comments; when there is no
    content keep the path as the pipeline text; upsert name and pipeline."""
    text = F.regexp_replace(decode_base64("content_b64"), r"(?m)^\s*#.*$", "")
    b = landed.select("id", "repository_id", "name", F.coalesce(text, F.col("path")).alias("pipeline"), order)
    return upsert(target, b, ["id"], order, WORKFLOW_UPDATABLE)


def import_workflow_runs(runs: DataFrame, workflows: DataFrame, landed: DataFrame, since,
                         order="arrival") -> tuple[DataFrame, DataFrame]:
    """I-05: runs created since ``since``; a run whose workflow is unknown adds
    a stub workflow named after the run (or 'unknown'); runs are upserted."""
    b = landed.where(F.col("created_at") >= F.lit(since))
    stubs = b.join(workflows.select(F.col("id").alias("workflow_id")), "workflow_id", "left_anti").select(
        F.col("workflow_id").alias("id"), "repository_id",
        F.coalesce(F.col("run_name"), F.lit("unknown")).alias("name"), F.lit(None).cast("string").alias("pipeline"),
        order,
    )
    new_workflows = insert_ignore(workflows, stubs, ["id"], order)
    new_runs = upsert(runs, b.select(*runs.columns, order), ["id"], order, RUN_UPDATABLE)
    return new_runs, new_workflows


def iac_lead_times(commits: DataFrame, links: DataFrame, team, home_repo: str | None = None) -> DataFrame:
    """I-06: PRs reached from commits under the infrastructure path.

    ``commits``: (repository_id, repository_full_name, sha, author);
    ``links``: (repository_id, sha, number, title, user_login, created_at,
    merged_at). A commit takes its PR number from the links; then see
    :func:`iac_from_numbered`.
    """
    numbered = commits.join(links.select("repository_id", "sha", "number"), ["repository_id", "sha"], "inner")
    first = F.min_by(F.struct("title", "user_login", "created_at", "merged_at"), F.struct(F.col("merged_at").isNull(), F.col("sha")))
    prs = links.groupBy("repository_id", "number").agg(first.alias("p")).select("repository_id", "number", "p.*")
    return iac_from_numbered(numbered, prs, team, home_repo)


def iac_from_numbered(commits: DataFrame, prs: DataFrame, team, home_repo: str | None = None) -> DataFrame:
    """Merged PRs with infrastructure commits: lead time in days to 2 places and
    their reviewers, the distinct lower-cased team authors of the commits other
    than the PR author and 'web-flow', sorted.

    ``commits``: (repository_id, repository_full_name, number, author). They are
    reduced to one row per PR before anything is joined. The set of team authors
    is a bit mask, so the reduction is a plain hash aggregate with map-side
    combine however long the history of a PR.
    """
    names = sorted({m.lower() for m in team} - {"web-flow"})
    masks = [names[i:i + 62] for i in range(0, len(names), 62)]
    if home_repo is not None:
        commits = commits.where(F.split_part("repository_full_name", F.lit("/"), F.lit(2)) != home_repo)
    ca = F.lower("author")

    def mask(part: list[str]) -> Column:
        bit = F.lit(0).cast("long")
        for i, m in enumerate(part):
            bit = F.when(ca == m, F.lit(1 << i).cast("long")).otherwise(bit)
        return F.bit_or(bit)

    per_pr = commits.groupBy("repository_id", "repository_full_name", "number").agg(
        F.count(F.lit(1)).alias("__commits"), *[mask(part).alias(f"__m{k}") for k, part in enumerate(masks)])
    authors = [F.when(F.getbit(f"__m{k}", F.lit(i)) == 1, F.lit(m)) for k, part in enumerate(masks) for i, m in enumerate(part)]
    found = F.array_compact(F.array(*authors)) if authors else F.array().cast("array<string>")
    own = F.lower("user_login")
    return per_pr.join(prs.where(F.col("merged_at").isNotNull()), ["repository_id", "number"], "inner").select(
        "repository_id",
        "repository_full_name",
        F.col("number").alias("pr_number"),
        "title",
        F.coalesce(F.col("user_login"), F.lit("unknown")).alias("author"),
        "created_at",
        "merged_at",
        round_half_up(elapsed_seconds("created_at", "merged_at") / 86400.0, 2).alias("lead_time_days"),
        F.when(own.isNull(), found).otherwise(F.array_remove(found, own)).alias("target_authors"),
    )


def new_repositories(repositories: DataFrame, full_names: DataFrame) -> DataFrame:
    """Rows for the full names (column ``full_name``) that are not stored yet (K-08): organisation and
    name from the two parts, ids counting on from the greatest stored one in the order of the names.
    The count runs over new repositories only, a handful in a run."""
    fresh = ensure_rows(repositories.select("full_name").limit(0), full_names, "full_name").join(
        repositories.select("full_name"), "full_name", "left_anti").where("full_name is not null")
    last = F.coalesce(repositories.agg(F.max("id")).scalar(), F.lit(-1))
    return fresh.select(
        (last + F.row_number().over(Window.orderBy("full_name"))).cast(repositories.schema["id"].dataType).alias("id"),
        F.split_part("full_name", F.lit("/"), F.lit(2)).alias("name"), "full_name",
        F.split_part("full_name", F.lit("/"), F.lit(1)).alias("organization"))


def import_member_commits(target: DataFrame, landed: DataFrame, repositories: DataFrame, order="arrival",
                          message_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """I-07: member commits; the repository comes from the full name and is created when it is not stored yet;
    insert-ignore on sha (first wins). ``message_chars`` cuts messages (the original stores 500 characters).
    Returns the commits and the repositories."""
    repos = repositories.unionByName(
        new_repositories(repositories, landed.select(F.col("repository_full_name").alias("full_name"))).select(*repositories.columns))
    message = F.col("message") if message_chars is None else F.substring("message", 1, message_chars)
    b = landed.withColumn("message", message) if "message" in landed.columns else landed
    known = repos.select(F.col("full_name").alias("repository_full_name"), F.col("id").alias("repository_id"))
    b = b.drop("repository_id").join(known, "repository_full_name", "inner")
    return insert_ignore(target, b, ["sha"], order), repos


def import_code_search(target: DataFrame, landed: DataFrame, query: str, order="arrival") -> DataFrame:
    """I-09: hits without repository dropped; the query's rows are replaced;
    (query, repository, path) is unique but a NULL path never collides."""
    b = landed.where(F.col("repository_full_name").isNotNull()).select(
        F.lit(query).alias("query"), "repository_full_name", "path", order
    )
    fresh = insert_ignore(target.limit(0), b, ["query", "repository_full_name", "path"], order,
                          nulls_collide=False)
    return replace_by_key(target, fresh, ["query"])


def import_terraform_modules(target: DataFrame, scanned: DataFrame, order="arrival") -> DataFrame:
    """I-11: empty version / path → NULL; the repositories present in the scan
    are replaced; a repository with an empty scan keeps its rows."""
    b = scanned.select(
        "repository", F.col("source").alias("module"),
        F.nullif(F.col("filePath"), F.lit("")).alias("file_path"),
        F.nullif(F.col("version"), F.lit("")).alias("version"), order,
    )
    fresh = insert_ignore(target.limit(0), b, ["repository", "module", "file_path"], order, nulls_collide=False)
    return replace_by_key(target, fresh, ["repository"])


def import_registry_releases(target: DataFrame, summary: DataFrame) -> DataFrame:
    """I-10 write rule: (module, provider, major) upsert of count and latest only."""
    return upsert(target, summary.withColumn("__o", F.lit(0)), ["module_name", "provider", "major_version"], "__o",
                  RELEASE_UPDATABLE)
