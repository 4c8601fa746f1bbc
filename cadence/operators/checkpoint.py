"""Incremental-load log (X-01 … X-05) as an append-only DataFrame.

Each run appends event rows (run id, key, since, status, at); the current
state of a run is its latest event. Whether work is already done, and what is
still pending, are joins against that state — no row is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordinal import join_null_safe

LOG_SCHEMA = "run_id string, entity_type string, repository_id int, since_date timestamp_ntz, status string, at timestamp_ntz"
DONE, RUNNING, FAILED, INTERRUPTED = "done", "running", "failed", "interrupted"


def checkpoint_key(entity: Column | str, name: Column | str | None = None) -> Column:
    """``entity`` or ``entity:name`` (X-01)."""
    e = F.col(entity) if isinstance(entity, str) else entity
    if name is None:
        return e
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.isNull() | (n == ""), e).otherwise(F.concat_ws(":", e, n))


def run_state(log: DataFrame) -> DataFrame:
    """Latest status per run with its start (since) and completion time (X-03)."""
    return log.groupBy("run_id").agg(
        F.first("entity_type").alias("entity_type"),
        F.first("repository_id", ignorenulls=True).alias("repository_id"),
        F.first("since_date", ignorenulls=True).alias("since_date"),
        F.max_by("status", F.struct("at", F.when(F.col("status") == RUNNING, 0).otherwise(1))).alias("status"),
        F.max(F.when(F.col("status") != RUNNING, F.col("at"))).alias("completed_at"),
    )


def start_runs(requested: DataFrame, at, run_id: Column | None = None) -> DataFrame:
    """Event rows opening a run for each requested item (X-03). A run is one
    attempt: the time it starts is part of its id, so a later attempt that fails
    does not undo an earlier one that was done."""
    rid = run_id if run_id is not None else F.concat_ws(
        "|", F.col("entity_type"), F.col("since_date").cast("string"), F.lit(at).cast("timestamp_ntz").cast("string"))
    return requested.select(
        rid.alias("run_id"), "entity_type", F.col("repository_id").cast("int"), "since_date",
        F.lit(RUNNING).alias("status"), F.lit(at).cast("timestamp_ntz").alias("at"),
    )


def finish_runs(started: DataFrame, ok: Column, at) -> DataFrame:
    """Event rows closing runs as done or failed (X-03)."""
    return started.select(
        "run_id", "entity_type", "repository_id", "since_date",
        F.when(ok, F.lit(DONE)).otherwise(F.lit(FAILED)).alias("status"),
        F.lit(at).cast("timestamp_ntz").alias("at"),
    )


def clean_stale(log: DataFrame, at) -> DataFrame:
    """Events marking runs still running as interrupted (X-04)."""
    s = run_state(log).where(F.col("status") == RUNNING)
    return s.select(
        "run_id", "entity_type", "repository_id", "since_date", F.lit(INTERRUPTED).alias("status"),
        F.lit(at).cast("timestamp_ntz").alias("at"),
    )


def with_coverage(requested: DataFrame, log: DataFrame, name: str = "covered") -> DataFrame:
    """``requested`` with a flag: a finished run of the entity began no later than the requested since and ended
    no earlier (X-02). A NULL entity or since (a bad date) is never covered.

    Instead of comparing a request with every run before it (a range join), the
    latest end of all runs that began up to the requested since is looked up: runs and
    requests are sorted together, and a running maximum of the ends goes over them.
    Runs and requests are cut by entity and month; months before count by
    their maximum alone, so no task sorts more than a month of an entity.
    """
    done = run_state(log).where(
        (F.col("status") == DONE) & F.col("since_date").isNotNull() & F.col("completed_at").isNotNull() & F.col("entity_type").isNotNull())
    runs = done.groupBy(F.col("entity_type").alias("__k"), F.col("since_date").alias("__s")).agg(F.max("completed_at").alias("__c"))
    asked = requested.select(F.struct(*requested.columns).alias("__row"), F.col("entity_type").alias("__k"), F.col("since_date").alias("__s"))
    none = F.lit(None)
    both = runs.withColumn("__row", none.cast(asked.schema["__row"].dataType)).withColumn("__asks", F.lit(0)).unionByName(
        asked.withColumns({"__c": none.cast("timestamp_ntz"), "__asks": F.lit(1)}))
    both = both.withColumn("__month", F.trunc(F.col("__s").cast("date"), "month")).repartition("__k", "__month")
    upto = Window.partitionBy("__k", "__month").orderBy("__s", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__here", F.max("__c").over(upto))
    months = both.groupBy("__k", "__month").agg(F.max("__c").alias("__latest"))
    earlier = Window.partitionBy("__k").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("__before", F.max("__latest").over(earlier)).drop("__latest")
    placed = join_null_safe(both.where("__asks = 1"), months, ["__k", "__month"])
    covered = F.coalesce(F.greatest("__here", "__before") >= F.col("__s"), F.lit(False)) & F.col("__k").isNotNull()
    return placed.select(*[F.col("__row").getField(c).alias(c) for c in requested.columns], covered.alias(name))


def done_already(requested: DataFrame, log: DataFrame) -> DataFrame:
    """Requested items covered by a finished run (X-02)."""
    return with_coverage(requested, log, "__covered").where("__covered").drop("__covered")


def pending_work(requested: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """Requested minus done, unless forced (X-05); requests that repeat stay as often as they come."""
    if force:
        return requested
    return with_coverage(requested, log, "__covered").where("not __covered").drop("__covered")
