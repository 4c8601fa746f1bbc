"""The composite operators on their own, over the driver's tables (registered queries)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.config import DEFAULTS, Defaults
from cadence.functions import to_day
from cadence.operators.calendar import open_per_day
from cadence.operators.checkpoint import DONE, FAILED, RUNNING, checkpoint_key, pending_work
from cadence.operators.latest import ends_per_key, latest_per_key
from cadence.operators.means import mean_states, roll_up, state_mean
from cadence.operators.membership import membership_counts, membership_split
from cadence.operators.related import first_related, last_related
from cadence.operators.shape import pivot_forward_fill, rate_by, size_buckets
from cadence.operators.trend import trend_line
from cadence.operators.versions import version_drift
from cadence.plans import iac, ingest, reviews
from cadence.plans.common import with_repo
from cadence.plans.dashboard import pr_weekly_results
from cadence.session import ensure_checkpoint_dir
from cadence.sources.landed import (parse_module_scan, parse_published_at, parse_registry_modules, parse_registry_versions, parse_tracker_lines)
from cadence.sources.slices import sliced_period, write_sliced
from cadence.sources.tables import Tables, replace_all, replace_partitions

# --- fixed values: the scenarios ---
PARENT_DAYS = 720
STALE_KEY, STALE_DAYS = 3, 700
SLICED_DAYS = 10
SIZE_EDGES, SIZE_LABELS = [10, 20, 30, 40], ["1-10", "11-20", "21-30", "31-40", "40+"]
# --- end of fixed values ---


def _scratch(t: Tables, name: str) -> str:
    """A new folder for a stored table, in the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.raw.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def latest_event(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """latest_per_key: the last event of each user and type."""
    return latest_per_key(t.raw.events, ["user_id", "event_type"], ["ts", "event_id"], ["ts", "event_id", "value", "props"])


def event_ends(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """ends_per_key: value of the first event, and type of the last one, of each user."""
    out = ends_per_key(t.raw.events, "user_id", ["ts", "event_id"], first=["value"], last=["event_type"])
    return out.select("user_id", F.col("value").alias("first_value"), F.col("event_type").alias("last_type"))


def period_of_stale_keys(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """trailing_period over stored slices: the last days of each repository's runs; one repository stopped long ago."""
    repo = (F.col("user_id") % 25).cast("int")
    late = F.when(repo == STALE_KEY, F.col("ts") - F.make_dt_interval(F.lit(STALE_DAYS))).otherwise(F.col("ts"))
    runs = t.raw.events.select("event_id", repo.alias("repository_id"), late.alias("created_at"), "value")
    stored = write_sliced(runs, _scratch(t, "sliced-runs"), "repository_id", "created_at")
    return sliced_period(stored, SLICED_DAYS).select("event_id", "repository_id", "created_at", "max_date")


def _recent_orders(t: Tables) -> DataFrame:
    o = t.raw.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    return o.where(F.col("o_orderdate") >= t.raw.orders.agg(F.max("o_orderdate") - F.make_dt_interval(F.lit(PARENT_DAYS))).scalar())


def _shipments(t: Tables) -> DataFrame:
    return t.raw.lineitem.select(F.col("l_orderkey").alias("key"), "l_returnflag", F.when(
        F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("shipped_at"))


def first_shipment(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """first_related: orders of the period with their first shipment; items of other orders go where they are read."""
    return first_related(_recent_orders(t), _shipments(t), ("o_orderkey", "key"), "shipped_at", name="first_shipped", prefilter=True)


def last_return(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """last_related: orders of the period with their last accepted item; an undated one makes the value NULL."""
    return last_related(_recent_orders(t), _shipments(t), ("o_orderkey", "key"), "shipped_at", where=F.col("l_returnflag") == "A",
                        name="last_accepted", prefilter=True)


def daily_trend(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """trend_line: orders per day and priority with the fitted value; x = days since the first order of all."""
    first = t.raw.orders.agg(to_day(F.min("o_orderdate"))).scalar()
    daily = t.raw.orders.groupBy(F.col("o_orderpriority").alias("priority"), to_day("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"))
    return trend_line(daily.withColumn("x", F.date_diff("day", first)), "priority", "x", "orders", name="trend").drop("x")


def bucket_means(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """bucket_mean: mean order total per priority and week, month and quarter, from states of days."""
    days = mean_states(t.raw.orders, "o_orderpriority", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)"))
    wide = roll_up(days, "o_orderpriority", ["week", "month", "quarter"])
    return wide.select("o_orderpriority", "grain", "slot", "n", state_mean(digits=2).alias("mean_total"))


def members_of_prs(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """membership_counts: PRs per repository and team member, as author or as another's merger."""
    p = with_repo(t.need("pull_requests"), t)
    return membership_counts(p, t.need("dx_team_members"), ["author", "merged_by"], "repository", [
        F.count(F.lit(1)).alias("prs"), F.count_if(F.col("merged_at").isNotNull()).alias("merged")])


def members_inside_outside(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """membership_split: PRs per repository by mergers in the team and others."""
    return membership_split(with_repo(t.need("pull_requests"), t), t.need("dx_team_members"), "merged_by", ["repository"])


def pending_syncs(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """pending_work: every order is a run of its priority and customer group, and a request of the next group."""
    def entity(shift: int):
        return checkpoint_key("o_orderpriority", ((F.col("o_custkey") + shift) % 200).cast("string"))

    o = t.raw.orders
    begun = F.col("o_orderdate")
    ended = begun + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))
    event = o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), entity(0).alias("entity_type"), F.lit(None).cast("int").alias("repository_id"),
        begun.alias("since_date"), F.explode(F.array_compact(F.array(
            F.struct(F.lit(RUNNING).alias("status"), begun.alias("at")),
            F.when(F.col("o_orderstatus") == "F", F.struct(F.lit(DONE).alias("status"), ended.alias("at"))),
            F.when(F.col("o_orderstatus") == "O", F.struct(F.lit(FAILED).alias("status"), ended.alias("at")))))).alias("e"))
    log = event.select("run_id", "entity_type", "repository_id", "since_date", "e.status", "e.at")
    asked = o.select("o_orderkey", entity(1).alias("entity_type"), F.col("o_orderdate").alias("since_date"))
    return pending_work(asked, log)


def partitions_replaced(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Replacement in place: modules stored by brand; a scan of some brands replaces their partitions, an empty one nothing."""
    parts = t.raw.part.select("p_partkey", "p_name", "p_size", F.col("p_brand").alias("repository"))
    path = _scratch(t, "modules")
    replace_partitions(parts, path, "repository")
    scan = parts.where(F.col("repository").contains("#2") & (F.col("p_size") > 10)).withColumn("p_name", F.concat(F.lit("new "), "p_name"))
    replace_partitions(scan, path, "repository")
    return replace_partitions(scan.where(F.lit(False)), path, "repository")


def table_replaced(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """Full replace: regions' suppliers stored, replaced by those with an account in credit; an empty batch changes nothing."""
    s = t.raw.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    path = _scratch(t, "suppliers")
    replace_all(s, path)
    replace_all(s.where("s_acctbal >= 0"), path)
    replace_all(s.where(F.lit(False)), path)
    return t.raw.spark.read.schema(s.schema).parquet(path)


def open_orders(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """open_per_day: orders open on each day per priority; finished ones close after a number of days."""
    o = t.raw.orders
    end = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int")))
    last = o.agg(F.max("o_orderdate")).scalar()
    return open_per_day(o.withColumn("closed_at", end), "o_orderpriority", "o_orderdate", "closed_at", last, count_name="open_orders")


def event_rates(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """rate_by: purchases and errors among the events of each user."""
    return rate_by(t.raw.events, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


def part_sizes(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """size_buckets: parts per brand and size range."""
    return size_buckets(t.raw.part, "p_brand", "p_size", SIZE_EDGES, SIZE_LABELS, digits=2)


def drift_of_all_uses(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """version_drift: every module use with its status, the shared ones flagged."""
    return version_drift(t.need("terraform_modules"), t.need("terraform_registry_releases"), d.dx_module_markers, keep_all=True)


def import_workflows(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-04, S-03: workflow files land in base64, some malformed or missing; stored workflows take name and text."""
    w = t.need("workflows")
    u = F.col("id")
    text = F.concat(F.lit("name: x\n# a comment\n  # another\nuses: "), F.coalesce("pipeline", F.lit("none")))
    content = F.when(u % 7 == 0, F.lit("%%% not base64")).when(u % 7 != 1, F.base64(F.encode(text, "utf-8")))
    landed = w.select("id", "repository_id", F.concat(F.lit("new "), F.col("name")).alias("name"), content.alias("content_b64"),
                      F.concat(F.lit("path/"), u.cast("string")).alias("path"), u.alias("arrival"))
    return ingest.import_workflows(w.where(u % 3 != 0), landed)


def import_tracker(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-12, S-06, S-07, P-17: exports per priority, one with its columns in another order, built as lines of text."""
    o, date = t.raw.orders, F.col("o_orderdate")
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    sent = F.concat(F.lit('"'), F.dayofmonth(date).cast("string"), F.lit("/"), F.month(date).cast("string"), F.lit("/"), two(F.year(date)),
                    F.lit(", 9:"), (F.col("o_orderkey") % 60).cast("string"), F.lit('"'))
    due = F.when(F.col("o_orderstatus") == "F", F.date_format(date, "yyyy-MM-dd")).when(F.col("o_orderstatus") == "O", F.lit("undefined")).otherwise(F.lit(""))
    fields = [sent, due, F.concat(F.lit('"kind, '), F.col("o_custkey").cast("string"), F.lit('"')), F.col("o_orderpriority"),
              (F.col("o_orderstatus") == "F").cast("string"), F.concat(F.lit("  "), F.col("o_orderstatus"))]
    heads = ["Data di invio", "DATA DI SCADENZA", "Tipologia richiesta", "Priorità", "Completato", "Status"]
    turned = F.col("o_orderpriority") == "5-LOW"
    line = F.when(turned, F.concat_ws(",", *reversed(fields))).otherwise(F.concat_ws(",", *fields))
    rows = o.select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("at"), line.alias("value"))
    head = F.when(F.col("file") == "5-LOW", F.lit(",".join(reversed(heads)))).otherwise(F.lit(",".join(heads)))
    heads_of = o.select(F.col("o_orderpriority").alias("file")).distinct().select("file", F.lit(-1).cast("bigint").alias("at"), head.alias("value"))
    blank = heads_of.select("file", F.lit(-2).cast("bigint").alias("at"), F.lit("   ").alias("value"))
    return parse_tracker_lines(rows.unionByName(heads_of).unionByName(blank))


def module_scan(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """S-04: module scans as JSON text, one per brand, with fields of the wrong type and items that are no objects."""
    p, k = t.raw.part, F.col("p_partkey")
    item = F.to_json(F.struct(
        F.col("p_type").alias("source"), F.when(k % 3 != 0, F.lit("registry")).alias("sourceType"), F.col("p_name").alias("filePath"),
        F.col("p_size").alias("version"), k.alias("lineNumber")))
    item = F.when(k % 11 == 0, F.lit('"no object"')).when(k % 13 == 0, F.lit('{"source": 5, "lineNumber": "x"}')).otherwise(item)
    text = F.concat(F.lit('{"modules": ['), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]}"))
    scans = p.groupBy("p_brand").agg(text.alias("text"))
    odd = p.select(F.concat(F.lit("bad "), F.col("p_brand")).alias("p_brand")).distinct().withColumn("text", F.lit('{"modules": ['))
    return parse_module_scan(scans.unionByName(odd), "text", "p_brand")


def registry_pages(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """S-05: registry pages as JSON text; modules without a text name, provider and namespace drop, as do versions that are no text."""
    p, k = t.raw.part, F.col("p_partkey")
    module = F.struct(F.col("p_type").alias("name"), F.when(k % 5 != 0, F.lit("aws")).alias("provider"), F.col("p_brand").alias("namespace"))
    pages = p.select(F.to_json(F.struct(F.array(module).alias("modules"))).alias("text"))
    modules = parse_registry_modules(pages, "text").groupBy("name", "provider", "namespace").agg(F.count(F.lit(1)).alias("pages"))
    version = F.when(k % 4 == 0, F.lit('{"version": 7}')).otherwise(
        F.concat(F.lit('{"version": "'), (k % 9).cast("string"), F.lit(".0."), F.col("p_size").cast("string"), F.lit('"}')))
    listed = p.select(k.alias("id"), "p_type", "p_brand", F.concat(F.lit('{"modules": [{"versions": ['), version, F.lit("]}]}")).alias("text"))
    versions = parse_registry_versions(listed, "text", ["p_type", "p_brand"]).groupBy("p_type", "p_brand").agg(
        F.countDistinct("version").alias("versions"), F.max("version").alias("greatest_text"))
    return modules.join(versions, (modules["name"] == versions["p_type"]) & (modules["namespace"] == versions["p_brand"]), "left").drop("p_type", "p_brand")


def published_dates(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """S-05: version documents landed as JSON lines; dates with offsets count in UTC, bad ones are NULL."""
    o, k = t.raw.orders, F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.lit("soon")).when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'"), F.lit("10:30:00"), F.when(k % 5 == 2, F.lit("Z")).otherwise(F.lit("+02:00"))))
    doc = F.to_json(F.struct(k.alias("id"), text.alias("published_at")))
    path = _scratch(t, "documents")
    o.select(doc.alias("value")).write.text(path)
    landed = t.raw.spark.read.text(path)
    read = landed.select(F.from_json("value", "id bigint").alias("d"), parse_published_at("value").alias("published_at"))
    return read.select("d.id", "published_at")


def import_registry_releases(t: Tables, d: Defaults = DEFAULTS, **_) -> DataFrame:
    """I-10: stored releases keep their first version and date; a new summary updates count and latest version only."""
    r = t.need("terraform_registry_releases")
    stored = r.where(F.col("major_version") != 3).select(
        "module_name", "provider", "major_version", F.lit("v0.0.1").alias("first_release_version"), "release_date",
        F.lit(1).cast("bigint").alias("releases_count"), F.lit("none").alias("latest_version"))
    return ingest.import_registry_releases(stored, r.where(F.col("provider") == "aws"))


def iac_supervised_wide(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """H-01 on the IaC series: supervised and unsupervised side by side, gaps carried forward."""
    long = iac.iac_supervised_cumulative(t, days, as_of, d)
    return pivot_forward_fill(long, "repository", "run_date", "pr_type", "cumulative_count",
                              {iac.SUPERVISED_LABEL: "supervised", iac.UNSUPERVISED_LABEL: "unsupervised"})


def review_matrix_no_self(t: Tables, days: int = 120, as_of=None, d: Defaults = DEFAULTS) -> DataFrame:
    """F-15: the review matrix without authors who review themselves; here the merger stands for the author."""
    p = t.need("pull_requests")
    own = Tables(repositories=t.need("repositories"), pull_request_reviews=t.need("pull_request_reviews"),
                 pull_requests=p.withColumn("author", F.col("merged_by")))
    return reviews.review_matrix(own, days, as_of, d, drop_self=True)


STATIC = {
    "latest_per_key": latest_event, "ends_per_key": event_ends, "trailing_period": period_of_stale_keys,
    "first_related": first_shipment, "last_related": last_return, "trend_line": daily_trend, "bucket_mean": bucket_means,
    "membership_counts": members_of_prs, "membership_split": members_inside_outside, "pending_work": pending_syncs,
    "replace_partitions": partitions_replaced, "replace_all": table_replaced, "open_per_day": open_orders, "rate_by": event_rates,
    "size_buckets": part_sizes, "version_drift": drift_of_all_uses, "import_workflows": import_workflows, "import_tracker": import_tracker,
    "import_registry_releases": import_registry_releases, "parse_module_scan": module_scan, "parse_registry": registry_pages,
    "parse_published_at": published_dates,
}
PERIODIC = {"pr_weekly_results": pr_weekly_results, "iac_supervised_wide": iac_supervised_wide, "review_matrix_no_self": review_matrix_no_self}
