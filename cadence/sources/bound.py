"""Bound views: the stored tables derived from the driver's parquet tables.

This is the test binding (FIXTURES.md §B) written with the DataFrame API so the
scans prune columns and the joins shuffle as little as possible:

* one shuffle of ``lineitem`` and ``orders`` by order key builds every per-order
  fact; the group-by that follows reuses that partitioning;
* ``pull_requests`` and ``tracker_requests`` come from the same order facts
  instead of joining orders twice;
* small dimensions (nation, region) are left to the planner, which broadcasts
  them from their measured size — no hint on anything that grows with data.

The SQL form of the same views (for DuckDB) lives in ``oracle/views.py``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.sources.tables import Tables

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# --- fixed values of the test binding (FIXTURES.md §B) ---
BOUND_BOTS = ("MACHINERY",)
BOUND_TEAM = ("BUILDING", "rev0", "rev1", "rev2")
BOUND_CODE_SEARCH_QUERY = "acme/dx org:acme"
BOUND_PIPELINE_PREFIX = "/"
BOUND_PIPELINE_LEAD = 'href="'
# --- end of fixed values ---


def bound_defaults(base: Defaults = DEFAULTS) -> Defaults:
    """Defaults with the binding's stand-ins for bots and the team."""
    return base.with_(bots=BOUND_BOTS, team=BOUND_TEAM, code_search_query=BOUND_CODE_SEARCH_QUERY)


class Raw:
    """Readers of the driver tables under one folder; each table is opened once
    (its footer read once) however many views use it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]


def repositories(raw: Raw) -> DataFrame:
    """One per nation, with names that the repository rules look for (own, shared, infrastructure), and one
    repository without any fact. All parts have a size that the planner knows, so facts are never dealt by the few ids."""
    n, r = raw.nation, raw.region
    key = F.col("n_nationkey")
    name = (
        F.when(key == 1, F.lit("dx"))
        .when(key == 5, F.lit("technology-radar"))
        .when(key % 8 == 2, F.concat(F.col("r_name"), F.lit("-dx-"), F.col("n_name")))
        .when(key % 8 == 3, F.concat(F.lit("terraform-"), F.col("n_name")))
        .when(key % 8 == 4, F.concat(F.lit("eng-"), F.col("n_name")))
        .otherwise(F.col("n_name"))
    )
    named = n.join(r, n.n_regionkey == r.r_regionkey).select(key.alias("id"), name.alias("name"), F.col("r_name").alias("organization"))
    empty = raw.spark.range(1).select(F.lit(99).cast(named.schema["id"].dataType).alias("id"), F.lit("EMPTY").alias("name"),
                                      F.lit("AFRICA").alias("organization"))
    return named.unionByName(empty).select(
        "id", "name", F.concat(F.col("organization"), F.lit("/"), F.col("name")).alias("full_name"), "organization")


def order_facts(raw: Raw) -> DataFrame:
    """One row per order with its line-item summary and customer attributes."""
    o = raw.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    li = raw.lineitem.select("l_orderkey", "l_shipdate", "l_quantity")
    per_order = (
        o.join(li, o.o_orderkey == li.l_orderkey, "left")
        .groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .agg(
            F.min(F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))).alias("merged_at"),
            (F.sum("l_quantity").cast("bigint") * F.when(F.col("o_orderkey") % 5 == 0, 4).otherwise(1)).alias("additions"),
            F.count("l_orderkey").alias("n_items"),
        )
    )
    c = raw.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return per_order.join(c, per_order.o_custkey == c.c_custkey)


def pull_requests_from_facts(facts: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    merged = F.col("merged_at")
    return facts.select(
        key.alias("id"),
        F.col("c_nationkey").alias("repository_id"),
        key.alias("number"),
        F.when(key % 40 == 0, F.lit("Version Packages"))
        .otherwise(F.concat(F.lit("order "), key.cast("string")))
        .alias("title"),
        F.col("c_mktsegment").alias("author"),
        F.concat(F.lit("rev"), (F.col("o_custkey") % 20).cast("string")).alias("merged_by"),
        F.col("o_orderdate").alias("created_at"),
        merged.alias("merged_at"),
        F.when(merged.isNotNull(), merged)
        .when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL '30' DAY"))
        .alias("closed_at"),
        F.col("additions"),
        F.when(F.col("n_items") > 0, F.col("n_items")).alias("total_comments_count"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(1))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("int"))
        .otherwise(F.lit(0))
        .alias("draft"),
    )


def tracker_from_facts(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.col("o_orderdate").alias("submitted_at"),
        F.col("merged_at").alias("closed_at"),
        F.lower(F.col("c_mktsegment")).alias("category"),
        F.lower(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", F.lit("true")).otherwise(F.lit("false")).alias("is_closed"),
    )


def _items_with_repo(raw: Raw) -> DataFrame:
    li = raw.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate")
    o = raw.orders.select("o_orderkey", "o_custkey")
    c = raw.customer.select("c_custkey", "c_nationkey")
    oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey")
    return li.join(oc, li.l_orderkey == oc.o_orderkey)


def pull_request_reviews(raw: Raw) -> DataFrame:
    flag = F.col("l_returnflag")
    return _items_with_repo(raw).select(
        F.col("l_orderkey").alias("pull_request_id"),
        F.col("c_nationkey").alias("repository_id"),
        F.concat(F.lit("rev"), (F.col("l_suppkey") % 20).cast("string")).alias("reviewer"),
        F.when(flag == "A", "APPROVED").when(flag == "R", "CHANGES_REQUESTED").otherwise("COMMENTED").alias("state"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("submitted_at"),
    )


def commits(raw: Raw, repos: DataFrame) -> DataFrame:
    items = _items_with_repo(raw)
    r = repos.select("id", "full_name")
    return items.join(r, items.c_nationkey == r.id).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("sha"),
        F.col("c_nationkey").alias("repository_id"),
        F.col("full_name").alias("repository_full_name"),
        F.concat(F.lit("rev"), (F.col("l_suppkey") % 20).cast("string")).alias("author"),
        F.col("l_shipdate").alias("committer_date"),
    )


def workflows(raw: Raw) -> DataFrame:
    u = F.col("user_id")
    name = (
        F.when(u % 12 == 8, F.lit("Labeler"))
        .when(u % 6 == 2, F.lit("CodeQL"))
        .when(u % 6 == 0, F.concat(F.lit("Deploy "), (u % 12).cast("string")))
        .when(u % 6 == 1, F.concat(F.lit("Release "), (u % 12).cast("string")))
        .otherwise(F.concat(F.lit("Build "), (u % 12).cast("string")))
    )
    pipeline = (
        F.when(u % 5 == 0, F.lit(None).cast("string"))
        .when(u % 5 == 1, F.lit("uses: acme/dx/.github/workflows/infra_plan.yaml"))
        .when(u % 5 == 2, F.lit("uses: acme/dx/.github/workflows/infra_apply.yaml"))
        .when(u % 5 == 3, F.lit("infra_plan.yaml"))
        .otherwise(F.lit("ci.yaml"))
    )
    return (
        raw.events.select("user_id")
        .distinct()
        .select(u.alias("id"), (u % 25).alias("repository_id"), name.alias("name"), pipeline.alias("pipeline"))
    )


def workflow_runs(raw: Raw) -> DataFrame:
    et = F.col("event_type")
    return raw.events.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 25).alias("repository_id"),
        F.col("user_id").alias("workflow_id"),
        F.when(et == "purchase", "success")
        .when(et == "view", " success ")
        .when(et == "click", "success")
        .when(et == "error", "failure")
        .alias("conclusion"),
        F.when(et == "signup", "in_progress").otherwise("completed").alias("status"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("int"))).alias("updated_at"),
    )


def iac_lead_time_rows(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """The infrastructure ingest (I-06) over all commits: commit ``o-l`` belongs to PR ``o``."""
    from cadence.plans.ingest import iac_from_numbered

    numbered = commits.select(
        "repository_id", "repository_full_name", "author",
        F.split_part("sha", F.lit("-"), F.lit(1)).cast("bigint").alias("number"))
    p = prs.select("repository_id", "number", "title", F.col("author").alias("user_login"), "created_at", "merged_at")
    return iac_from_numbered(numbered, p, BOUND_TEAM, home_repo=DEFAULTS.dx_repo)


def terraform_modules(raw: Raw) -> DataFrame:
    k = F.col("p_partkey")
    t = F.lower(F.col("p_type"))
    module = (
        F.when(k % 7 == 0, F.concat(F.lit("./local/"), t))
        .when(k % 7 == 1, F.concat(F.lit("../shared/"), t))
        .when(k % 7 == 2, F.concat(F.lit("hashicorp/"), t, F.lit("/aws")))
        .otherwise(F.concat(F.lit("acme-dx/"), t, F.lit("/azurerm")))
    )
    version = (
        F.when(k % 6 == 0, F.lit(None).cast("string"))
        .when(k % 6 == 1, F.lit("main"))
        .otherwise(F.concat(F.lit("~> "), (k % 5).cast("string"), F.lit(".1")))
    )
    return raw.part.select(
        F.col("p_brand").alias("repository"),
        module.alias("module"),
        F.col("p_name").alias("file_path"),
        version.alias("version"),
    )


def registry_versions(raw: Raw) -> DataFrame:
    k = F.col("p_partkey")
    return raw.part.select(
        F.lower(F.col("p_type")).alias("module_name"),
        F.when(k % 2 == 0, "azurerm").otherwise("aws").alias("provider"),
        F.concat(
            F.when(k % 3 == 0, F.lit("v")).otherwise(F.lit("")),
            (F.col("p_size") % 4).cast("string"),
            F.lit("."),
            (k % 13).cast("string"),
            F.lit("."),
            (k % 11).cast("string"),
        ).alias("version"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int")).alias("published_at"),
    )


def code_search_results(raw: Raw, query: str = BOUND_CODE_SEARCH_QUERY) -> DataFrame:
    d = F.col("doc_id")
    return raw.documents.select(
        F.lit(query).alias("query"),
        F.concat(F.lit("org/"), F.col("source"), F.when(d % 7 == 0, F.lit("-dx")).otherwise(F.lit(""))).alias(
            "repository_full_name"
        ),
        d.cast("string").alias("path"),
    )


def team_members(spark: SparkSession, members=BOUND_TEAM) -> DataFrame:
    return spark.createDataFrame([(m,) for m in members], "username string")


def pipeline_files(raw: Raw) -> DataFrame:
    """Pages as searched files: repository = host of the URL, file = the URL."""
    return raw.pages.select(
        F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1).alias("repository"),
        F.col("url").alias("caller_file"),
        F.col("html").alias("content"),
    )


def dx_pipeline_usages(raw: Raw) -> DataFrame:
    from cadence.operators.usages import extract_usages

    return extract_usages(
        pipeline_files(raw), "content", prefix=BOUND_PIPELINE_PREFIX, lead=BOUND_PIPELINE_LEAD
    )


def terraform_registry_releases(raw: Raw) -> DataFrame:
    from cadence.operators.versions import release_summary

    return release_summary(registry_versions(raw))


class BoundTables(Tables):
    """Tables whose views are built on first use (a metric touching two tables
    does not plan the other eleven)."""

    _builders = {
        "repositories": lambda b: repositories(b.raw),
        "pull_requests": lambda b: pull_requests_from_facts(b.facts),
        "pull_request_reviews": lambda b: pull_request_reviews(b.raw),
        "workflows": lambda b: workflows(b.raw),
        "workflow_runs": lambda b: workflow_runs(b.raw),
        "iac_pr_lead_times": lambda b: iac_lead_time_rows(b.need("commits"), b.need("pull_requests")),
        "commits": lambda b: commits(b.raw, b.need("repositories")),
        "code_search_results": lambda b: code_search_results(b.raw),
        "dx_pipeline_usages": lambda b: dx_pipeline_usages(b.raw),
        "terraform_modules": lambda b: terraform_modules(b.raw),
        "terraform_registry_releases": lambda b: terraform_registry_releases(b.raw),
        "tracker_requests": lambda b: tracker_from_facts(b.facts),
        "dx_team_members": lambda b: team_members(b.raw.spark),
    }

    def __init__(self, raw: Raw):
        super().__init__()
        self.raw = raw
        self._facts: DataFrame | None = None

    @property
    def facts(self) -> DataFrame:
        if self._facts is None:
            self._facts = order_facts(self.raw)
        return self._facts

    def need(self, name: str) -> DataFrame:
        df = getattr(self, name)
        if df is None:
            df = self._builders[name](self)
            setattr(self, name, df)
        return df

    def names(self) -> list[str]:
        return list(self._builders)


_RAW_MEMO: dict[tuple, Raw] = {}


def _dir_stamp(sf_dir: str) -> tuple:
    """Names and times of the files of a folder of this machine; empty where they cannot be known."""
    try:
        return tuple(sorted((e.name, e.stat().st_mtime_ns) for e in os.scandir(sf_dir.removeprefix("file://"))))
    except OSError:
        return ()


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """All stored tables as lazy views over the driver's tables at ``sf_dir``.

    The parquet readers are shared by bindings of the same session and folder
    (keyed on the files' stamps), so a dashboard of sixty metrics opens each
    file once. A folder on another file system has no stamps; it gets readers of
    its own each time.
    """
    stamp = _dir_stamp(sf_dir)
    if not stamp:
        return BoundTables(Raw(spark, sf_dir))
    key = (id(spark), sf_dir, stamp)
    raw = _RAW_MEMO.get(key)
    if raw is None or raw.spark is not spark:
        raw = _RAW_MEMO[key] = Raw(spark, sf_dir)
    return BoundTables(raw)


_AS_OF_MEMO: dict[tuple, object] = {}


def bound_as_of(tables: Tables, lazy: bool = False):
    """The binding's "now": one day after the latest merge.

    By default it is computed once per data folder (a one-row aggregate) and
    passed on as a literal parameter, so the sixty metrics do not each re-run
    the order / line-item aggregation. ``lazy=True`` gives the scalar-subquery
    form instead (no job until the metric runs), as do folders of which it cannot
    be told whether they have changed.
    """
    prs = tables.need("pull_requests")
    folder_stamp = _dir_stamp(tables.raw.sf_dir) if isinstance(tables, BoundTables) else ()
    if lazy or not folder_stamp:
        return prs.agg(F.max("merged_at") + F.expr("INTERVAL '1' DAY")).scalar()
    raw = tables.raw
    key = (raw.sf_dir, folder_stamp)
    if key not in _AS_OF_MEMO:
        latest = prs.agg(F.max("merged_at").alias("m")).first()["m"]
        _AS_OF_MEMO[key] = latest
    latest = _AS_OF_MEMO[key]
    if latest is None:
        return F.lit(None).cast("timestamp_ntz")
    from cadence.functions.time import lit_ntz

    return lit_ntz(latest) + F.expr("INTERVAL '1' DAY")
