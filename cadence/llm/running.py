"""Running values over sorted rows without a task per key.

Rows are range-partitioned and sorted by (keys, order); every task runs through
its part once, and the table is written. A key that lies in several parts gets
the totals of its earlier parts added: such (part, key) pairs are at most two a
part, so they are broadcast. A key that holds any share of the rows is spread
like all others; no window or group sees more than (part, key) totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cadence.llm.common import stage

#: Rows of a task at least; beyond that there are as many parts as shuffle partitions or more.
ROWS_A_PART = 100_000


def _changes(col: pa.Array, before) -> np.ndarray:
    """True where a value differs from the one above; ``before`` is the value above the first, as an array of one or None."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    above = pa.concat_arrays([col[:1] if before is None else before, col[:-1]])
    null, null_above = pc.is_null(col), pc.is_null(above)
    differ = pc.or_(pc.fill_null(pc.not_equal(col, above), False), pc.xor(null, null_above)).to_numpy(zero_copy_only=False).copy()
    if before is None:
        differ[0] = True
    return differ


def _accumulate(values: np.ndarray, starts: np.ndarray, run: np.ndarray, carried: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(exclusive, inclusive) running values within runs; the first run goes on from ``carried``."""
    if how == "sum":
        total = np.cumsum(values)
        base = np.where(starts > 0, total[starts - 1], 0)
        base[0] -= carried
        inclusive = total - base[run]
        return inclusive - values, inclusive
    total = np.bitwise_xor.accumulate(values)
    base = np.where(starts > 0, total[starts - 1], 0)
    base[0] ^= carried
    inclusive = total ^ base[run]
    return inclusive ^ values, inclusive


def _part_runner(keys: list[str], values: dict[str, tuple[str, str]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, {name: 0 for name in values}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                new |= _changes(batch.column(k), last[k] if last else None)
            if not keys and last is None:
                new[0] = True
            begins = np.flatnonzero(new)
            starts = begins if len(begins) and begins[0] == 0 else np.concatenate([[0], begins])
            run_of = np.searchsorted(starts, np.arange(n), side="right") - 1
            fresh = bool(new[0])
            out = {}
            for name, (col, how) in values.items():
                v = np.ones(n, dtype=np.int64) if col == "*" else batch.column(col).to_numpy(zero_copy_only=False).astype(np.int64)
                before, upto = _accumulate(v, starts, run_of, 0 if fresh else carried[name], how)
                carried[name] = int(upto[-1])
                out[name] = pa.array(before, pa.int64())
            last = {k: batch.column(k)[n - 1:] for k in keys}
            yield pa.RecordBatch.from_arrays([*batch.columns, *out.values()], names=[*batch.schema.names, *out])
    return run


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], label: str,
            nth: str | None = None) -> DataFrame:
    """``df`` with, for each name of ``values``, what the rows of the same keys above a row come to.

    ``values`` maps a new column to (column, "sum" or "xor"); the column "*"
    counts rows. Columns hold integers without nulls. ``order`` has to be total
    but for rows that are the same in all columns that count. Null keys are
    equal. ``nth`` names a column that numbers all rows in their order, with
    gaps. ``df`` is read twice (for the bounds of the parts), so it should be
    a written table.
    """
    spark = df.sparkSession
    rows = df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_PART) if rows > 1000 else 1
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    parted = (df.repartitionByRange(parts, *by) if parts > 1 else df.coalesce(1)).sortWithinPartitions(*by)
    parted = parted.withColumn("_part", F.spark_partition_id())
    if nth:
        parted = parted.withColumn(nth, F.monotonically_increasing_id())
    columns = [*df.columns, *([nth] if nth else []), *values]
    schema = StructType([*parted.schema.fields, *(StructField(name, LongType()) for name in values)])
    done = stage(parted.mapInArrow(_part_runner(list(keys), values, None), schema), label)
    if parts == 1:
        return done.drop("_part")

    totals = {"sum": F.sum, "xor": F.bit_xor}
    own = done.groupBy("_part", *keys).agg(*[
        totals[how](F.lit(1) if col == "*" else F.col(col)).cast("long").alias(f"_of_{name}") for name, (col, how) in values.items()])
    same_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    earlier = same_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = own.withColumn("_first", F.min("_part").over(same_key)).withColumns({
        f"_up_{name}": totals[how](f"_of_{name}").over(earlier) for name, (_, how) in values.items()}).where("_part > _first")
    spans = spans.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_up_{name}" for name in values])
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = done.join(F.broadcast(spans), same, "left")
    new = {}
    for name, (_, how) in values.items():
        up = F.coalesce(f"_up_{name}", F.lit(0))
        new[name] = F.col(name) + up if how == "sum" else F.col(name).bitwiseXOR(up)
    return joined.withColumns(new).select(*columns)
