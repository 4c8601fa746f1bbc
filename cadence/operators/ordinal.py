"""Row ordinals over raw rows that survive a hot group (W-03).

``ROW_NUMBER() OVER (PARTITION BY key ORDER BY …)`` sends every row of a key to
one task; when one key holds a third of all rows that task sorts a third of the
data.

``cell_ordinal`` counts rows in a hierarchy of cells instead: days of a key, and
ranges of CELL numbers in a day. Running sums over days, and over the ranges of a
day, say how many rows come before a cell; only the rows of one cell, at most
CELL different numbers, are ranked against each other. It is a lazy plan: the
rows are shuffled by cell once, and the counts reuse that shuffle.

``row_ordinal`` takes any order, at the price of a job: it range-partitions on
(key, order…), pins partition and position by a reliable checkpoint in the
cluster's ``spark.checkpoint.dir`` and adds the counts of earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import ensure_checkpoint_dir


#: Numbers in a cell: what one window group sorts at most, when numbers do not repeat in a day of a key.
CELL = 4096


def ranked_cells(df: DataFrame, keys, day: str, number: str, y: Column | None = None, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) of an ordering of the rows of a key by ``day`` (a date), then ``number`` (an integer).

    ``rows`` has ``__cell`` and the rank in the cell, ``__rank``. ``cells`` has one
    row per cell with ``__before``, the rows of the key in earlier cells, and
    the moments of its key: ``__n`` rows, ``__y`` and ``__xy``, the sums of ``y`` and
    of ordinal times ``y``. A NULL day or number comes first, as in an ascending order.
    """
    cells = [*keys, day, "__cell"]
    rows = df.withColumn("__cell", F.floor(F.col(number).cast("bigint") / F.lit(cell)).cast("bigint")).repartition(*cells)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*cells).orderBy(number)))
    value = F.lit(0.0) if y is None else y
    # one array, so that the two readers below need the same columns and share one shuffle
    counts = rows.groupBy(*cells).agg(F.array(
        F.count(F.lit(1)).cast("double"), F.sum(value), F.sum(F.col("__rank") * value)).alias("__sums"))
    n, sum_y, sum_ranks = (F.get("__sums", F.lit(i)) for i in range(3))
    above = (Window.unboundedPreceding, -1)
    in_day = Window.partitionBy(*keys, day).orderBy("__cell").rowsBetween(*above)
    placed = counts.withColumn("__in_day", F.coalesce(F.sum(n).over(in_day), F.lit(0.0)))
    days = placed.groupBy(*keys, day).agg(F.sum(n).alias("__d"), F.sum(sum_y).alias("__dy"),
                                          F.sum(F.col("__in_day") * sum_y + sum_ranks).alias("__dxy"))
    whole = Window.partitionBy(*keys)
    days = days.withColumn("__earlier", F.coalesce(F.sum("__d").over(whole.orderBy(day).rowsBetween(*above)), F.lit(0.0)))
    days = days.select(*keys, day, "__earlier", F.sum("__d").over(whole).alias("__n"), F.sum("__dy").over(whole).alias("__y"),
                       F.sum(F.col("__dxy") + F.col("__earlier") * F.col("__dy")).over(whole).alias("__xy"))
    out = join_null_safe(placed, days, [*keys, day])
    return rows, out.select(*cells, (F.col("__earlier") + F.col("__in_day")).cast("bigint").alias("__before"), "__n", "__y", "__xy")


def cell_ordinal(df: DataFrame, keys, day: str, number: str, name: str = "x", cell: int = CELL) -> DataFrame:
    """1-based ordinal of each row within ``keys`` by ``day``, then ``number``; rows that repeat a number on a
    day of a key get ordinals in some order, one each."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows, cells = ranked_cells(df, keys, day, number, cell=cell)
    out = join_null_safe(rows, cells.drop("__n", "__y", "__xy"), [*keys, day, "__cell"])
    return out.withColumn(name, (F.col("__before") + F.col("__rank")).cast("bigint")).drop("__cell", "__rank", "__before")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL; the columns of the keys come once."""
    renamed = right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{i}"))
    return left.join(renamed, cond, "inner").drop(*[f"__r_{i}" for i in range(len(keys))])


def row_ordinal(df: DataFrame, keys, order: list, name: str = "x", partitions: int | None = None) -> DataFrame:
    """1-based ordinal of each row within ``keys`` in ``order`` (a total order).

    The checkpoint makes the result a materialised DataFrame: this call runs
    one job.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols: list[Column] = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order_cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("__pid", *keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first")
    )
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = tagged.join(counts, ["__pid", *keys], "inner").withColumn(
        name, (F.col("__before") + (F.col("__pos") - F.col("__first")) + 1).cast("bigint")
    )
    return out.drop("__pid", "__pos", "__n", "__first", "__before")


def row_ordinal_window(df: DataFrame, keys, order: list, name: str = "x") -> DataFrame:
    """Plain window form (one task per key) — for small inputs and tests."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)).cast("bigint"))
