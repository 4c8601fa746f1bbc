"""Stored facts in slices of a month and a group of keys, read for the periods of single keys only (F-02, F-03, A-12).

A period that counts back from the latest fact of its key (a repository whose last
run was three years ago) lies in months of its own. With facts partitioned by
month alone one such key opens the old months of all keys; here the partition
column joins month and group of keys, and the pairs that the anchors ask for are
joined to it, so Spark prunes partitions dynamically: the files of an old month
are read for the groups with a stale key, and no others.

``write_sliced`` stores the latest time per key beside the facts, so that reading
needs no pass over them to find the anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.util import as_col

#: Groups of keys; as many partitions a month at most.
GROUPS = 64
SLICE = "slice"


def slice_of(key, day, groups: int = GROUPS) -> Column:
    """Partition value: 100 * year + month of ``day``, then the group of the key; facts without time or key share slice -1."""
    month = F.year(as_col(day)) * 100 + F.month(as_col(day))
    group = F.pmod(F.xxhash64(as_col(key)), F.lit(groups))
    return F.when(as_col(key).isNotNull(), F.coalesce(month.cast("bigint") * groups + group, F.lit(-1))).otherwise(F.lit(-1)).cast("bigint")


@dataclass
class Sliced:
    """Facts partitioned by slice and time column, and the latest time per key."""
    facts: DataFrame
    anchors: DataFrame
    key: str
    ts: str
    anchor: str
    groups: int


def write_sliced(df: DataFrame, path: str, key: str, ts: str, anchor: str | None = None, groups: int = GROUPS, mode: str = "error") -> Sliced:
    """Store ``df`` under ``path``, sliced by ``key`` and ``ts``, with the latest ``anchor`` (by default ``ts``) per key.

    Rows are rebalanced by slice before the write: a slice has few files, and one
    that holds a large share of all rows is written by several tasks.
    """
    rows = df.withColumn(SLICE, slice_of(key, ts, groups)).hint("rebalance", F.col(SLICE))
    rows.write.mode(mode).partitionBy(SLICE).parquet(f"{path}/facts")
    read = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/facts")
    read.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(anchor or ts).alias("anchor")).write.mode(mode).parquet(f"{path}/anchors")
    return read_sliced(df.sparkSession, path, key, ts, anchor, groups)


def read_sliced(spark: SparkSession, path: str, key: str, ts: str, anchor: str | None = None, groups: int = GROUPS) -> Sliced:
    """What ``write_sliced`` has stored under ``path`` with the same arguments."""
    return Sliced(spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/anchors"), key, ts, anchor or ts, groups)


def sliced_period(stored: Sliced, days: int, default=None, upper: bool = False, name: str = "max_date") -> DataFrame:
    """Facts within the ``days`` before the anchor of their key, with the anchor as ``name``.

    The same rows as :func:`trailing_period` with an anchor per key; a key whose
    facts have no time takes ``default``. Without ``upper`` the anchor has to be the
    latest of the very time the facts are sliced by, as nothing is later then.
    """
    if not upper and stored.anchor != stored.ts:
        raise ValueError("a period without upper bound needs the anchor and the slices to be of one column")
    a = F.coalesce(F.col("anchor"), default) if default is not None else F.col("anchor")
    begin = F.col(name) - F.make_dt_interval(F.lit(int(days)))
    wanted = stored.anchors.select(F.col(stored.key).alias("__key"), a.alias(name)).where(begin <= F.col(name))
    months = F.sequence(F.trunc(begin.cast("date"), "month"), F.trunc(F.col(name).cast("date"), "month"), F.expr("interval 1 month"))
    wanted = wanted.select("__key", name, F.explode(months).alias("__month"))
    wanted = wanted.select("__key", name, slice_of("__key", "__month", stored.groups).alias("__slice"))
    facts = stored.facts
    rows = facts.join(wanted, (facts[SLICE] == wanted["__slice"]) & (facts[stored.key] == wanted["__key"]), "inner")
    rows = rows.where(F.col(stored.ts) >= begin)
    return (rows.where(F.col(stored.ts) <= F.col(name)) if upper else rows).drop("__key", "__slice", SLICE)
