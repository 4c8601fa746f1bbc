"""Shaping operators: buckets, top-k, first-row-per-key, pivot with forward
fill, shares and rates (P-12, O-02, O-03, H-01 … H-04, A-07, A-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.numeric import round_half_up, safe_div
from cadence.functions.util import as_col


def size_bucket(c, edges, labels) -> tuple[Column, Column]:
    """(label, order) of the first edge with ``c <= edge``; above all → last (P-12)."""
    c = as_col(c)
    label, order = None, None
    for i, edge in enumerate(edges):
        cond = c <= F.lit(edge)
        label = (F.when(cond, F.lit(labels[i])) if label is None else label.when(cond, F.lit(labels[i])))
        order = (F.when(cond, F.lit(i + 1)) if order is None else order.when(cond, F.lit(i + 1)))
    return label.otherwise(F.lit(labels[len(edges)])), order.otherwise(F.lit(len(edges) + 1))


def size_buckets(df: DataFrame, keys, col: str, edges, labels, digits: int = 0) -> DataFrame:
    """Count and mean of ``col`` per bucket and key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    label, order = size_bucket(col, edges, labels)
    return (
        df.groupBy(*keys, label.alias("size_range"), order.alias("sort_order"))
        .agg(F.count(F.lit(1)).alias("pr_count"), round_half_up(F.avg(col), digits).alias("avg_additions"))
    )


def top_k(df: DataFrame, keys, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key in ``order`` (O-02).

    Spark plans a partial WindowGroupLimit before the shuffle, so each map task
    sends at most k rows per key: a hot key cannot flood one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def first_per_key(df: DataFrame, keys, order: list[Column], cols: list[str]) -> DataFrame:
    """One row per key: the values of the first row in ``order`` (O-03, O-04).

    ``min_by`` on a struct of the order keys: each task sorts its rows by key and
    reduces them, so a hot key is one row per task before the shuffle.
    :func:`cadence.operators.latest.latest_per_key` does without the sort.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    payload = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(payload, rank).alias("__p"))
    return picked.select(*keys, *[F.col(f"__p.{c}").alias(c) for c in cols])


def pivot_forward_fill(df: DataFrame, keys, date: str, label: str, value: str, label_map: dict) -> DataFrame:
    """Long → wide by a label map, then carry the last non-zero value forward
    (H-01, H-02).

    Unmapped labels are dropped; missing = 0; a 0 after a positive value is a
    gap and takes the last positive value. The pivot values are given, so
    no extra job discovers them. The fill window runs over the pivoted rows
    (one per key and date).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    series = list(dict.fromkeys(label_map.values()))
    mapping = F.create_map(*[x for kv in label_map.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    mapped = df.select(
        *keys, date, F.col(label).alias("__label"), mapping[F.col(label)].alias("__series"), F.col(value).alias("__v")
    ).where(F.col("__series").isNotNull())
    # two labels of one series on one date: the later label (rows come label-sorted) wins
    wide = mapped.groupBy(*keys, date).pivot("__series", series).agg(F.max_by("__v", "__label"))
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = wide
    for s in series:
        cur = F.coalesce(F.col(s), F.lit(0))
        carried = F.coalesce(F.last(F.when(cur > 0, cur), ignorenulls=True).over(w), F.lit(0))
        out = out.withColumn(s, F.when(cur != 0, cur).otherwise(carried).cast("bigint"))
    return out


def class_share(df: DataFrame, keys, n: str, name: str = "share_pct", digits: int = 0) -> DataFrame:
    """Share of each row's ``n`` in its key's total, in percent (H-04)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys)
    return df.withColumn(name, round_half_up(safe_div(F.col(n), F.sum(n).over(w)) * 100.0, digits))


def rate_by(df: DataFrame, keys, good: Column, bad: Column | None = None, digits: int = 2) -> DataFrame:
    """Totals, good and bad counts and the good share in percent (A-07, A-08)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = [
        F.count(F.lit(1)).alias("total_runs"),
        F.sum(F.when(good, 1).otherwise(0)).cast("bigint").alias("successful_runs"),
    ]
    if bad is not None:
        aggs.append(F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("failed_runs"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn(
        "success_rate_percentage",
        round_half_up(F.col("successful_runs").cast("double") / F.col("total_runs").cast("double") * 100.0, digits),
    )


def percent_of(part: Column, total: Column, digits: int = 0) -> Column:
    """Rounded percentage, NULL for a zero total (H-03)."""
    return round_half_up(safe_div(part, total) * 100.0, digits)
