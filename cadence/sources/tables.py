"""The stored tables the metrics read, bundled as lazy DataFrames (S-01), and writers (K-06, K-09)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored columns; tables are read with these schemas, never inferred.
SCHEMAS = {
    "repositories": "id int, name string, full_name string, organization string",
    "pull_requests": "id bigint, repository_id int, number int, title string, author string, review_decision string, "
                     "created_at timestamp_ntz, closed_at timestamp_ntz, merged_at timestamp_ntz, merged_by string, "
                     "additions int, total_comments_count int, draft int",
    "pull_request_reviews": "id bigint, pull_request_id bigint, repository_id int, reviewer string, state string, "
                            "submitted_at timestamp_ntz",
    "workflows": "id bigint, repository_id int, name string, pipeline string",
    "workflow_runs": "id bigint, repository_id int, workflow_id bigint, conclusion string, status string, "
                     "created_at timestamp_ntz, updated_at timestamp_ntz",
    "iac_pr_lead_times": "id int, repository_id int, repository_full_name string, pr_number int, title string, author string, "
                         "created_at timestamp_ntz, merged_at timestamp_ntz, lead_time_days decimal(18,2), "
                         "target_authors array<string>",
    "commits": "sha string, repository_id int, repository_full_name string, author string, committer string, "
               "committer_date timestamp_ntz, message string",
    "code_search_results": "id int, query string, repository_full_name string, path string, fetched_at timestamp_ntz",
    "dx_pipeline_usages": "id int, repository string, caller_file string, dx_workflow string, ref string",
    "terraform_modules": "id int, repository string, module string, file_path string, version string",
    "terraform_registry_releases": "id int, module_name string, provider string, major_version int, "
                                   "first_release_version string, release_date timestamp_ntz, releases_count int, "
                                   "latest_version string",
    "tracker_requests": "id int, submitted_at timestamp_ntz, closed_at timestamp_ntz, category string, priority string, "
                        "is_closed string, status string, raw_submitted_at string, raw_closed_at string",
    "dx_team_members": "id int, username string",
    "config": "key string, value string",
    "sync_runs": "id int, entity_type string, repository_id int, started_at timestamp_ntz, completed_at timestamp_ntz, "
                 "since_date timestamp_ntz, status string",
}
TABLE_NAMES = tuple(SCHEMAS)


@dataclass
class Tables:
    """One DataFrame per stored table. Missing tables stay ``None``; a metric
    that needs one fails with a clear message."""

    repositories: DataFrame | None = None
    pull_requests: DataFrame | None = None
    pull_request_reviews: DataFrame | None = None
    workflows: DataFrame | None = None
    workflow_runs: DataFrame | None = None
    iac_pr_lead_times: DataFrame | None = None
    commits: DataFrame | None = None
    code_search_results: DataFrame | None = None
    dx_pipeline_usages: DataFrame | None = None
    terraform_modules: DataFrame | None = None
    terraform_registry_releases: DataFrame | None = None
    tracker_requests: DataFrame | None = None
    dx_team_members: DataFrame | None = None
    config: DataFrame | None = None
    sync_runs: DataFrame | None = None
    #: Facts stored in slices (``sources/slices.py``) by table and time column; metrics prefer them to the table.
    sliced: dict = field(default_factory=dict)
    #: The tables are files, not views: reading one twice is a scan of few columns, not a second derivation.
    stored: bool = False

    def need(self, name: str) -> DataFrame:
        df = getattr(self, name)
        if df is None:
            raise ValueError(f"table {name!r} is not loaded")
        return df

    def names(self) -> list[str]:
        return [f.name for f in fields(self) if f.name not in ("sliced", "stored") and getattr(self, f.name) is not None]


def read_tables(spark: SparkSession, root: str, names=TABLE_NAMES, missing_ok: bool = False) -> Tables:
    """Read stored tables written as ``<root>/<name>`` parquet folders, with their schemas.

    Spark looks the folders up, so any file system will do. A missing folder is
    an error; with ``missing_ok`` the table stays unset.
    """
    kw = {}
    for name in names:
        try:
            kw[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")
        except AnalysisException as e:
            if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
                raise
    return Tables(**kw, stored=True)


def write_tables(tables: Tables, root: str, mode: str = "overwrite") -> None:
    """Persist every loaded table as a parquet folder (K-06 full replace)."""
    for name in tables.names():
        tables.need(name).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def replace_partitions(batch: DataFrame, path: str, part_keys) -> DataFrame:
    """Replace in place the partitions of the table at ``path`` whose ``part_keys`` occur in ``batch`` (K-04, K-05).

    A dynamic partition overwrite: partitions that the batch does not touch keep
    their files, and an empty batch changes nothing. The batch is rebalanced by
    partition, so a partition has few files and a large one several writers.
    ``batch`` must not read the table itself. A batch against no table makes it.
    """
    part_keys = [part_keys] if isinstance(part_keys, str) else list(part_keys)
    rows = batch.hint("rebalance", *[F.col(k) for k in part_keys])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part_keys).parquet(path)
    return read_partitions(batch, path)


def read_partitions(like: DataFrame, path: str) -> DataFrame:
    """The stored table with the columns and types of ``like`` (partition values are not guessed from folder names)."""
    return like.sparkSession.read.schema(like.schema).parquet(path).select(*like.columns)


def replace_all(batch: DataFrame, path: str) -> bool:
    """Replace the whole table at ``path`` unless the batch is empty (K-06): an import without rows must not wipe a
    table. Returns whether it was replaced."""
    if batch.isEmpty():
        return False
    batch.write.mode("overwrite").parquet(path)
    return True


def write_results(results: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Store named result frames as ``<root>/<name>`` parquet folders (K-09)."""
    for name, df in results.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")
