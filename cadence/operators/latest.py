"""First or last row per key without a sort of the raw rows (J-06, O-03, O-04, K-01, K-02, I-10).

``min_by`` over a struct keeps a row in its buffer, which Spark can only do in a
sort aggregate: all raw rows are sorted before the first is dropped. Here the
order is split in two:

1. its leading columns of fixed width (booleans, integers, dates, timestamps)
   become one number that keeps their order: a BIGINT if 63 bits will do, else
   DECIMAL(38,0). The extreme number per key is a plain hash aggregate with
   map-side combine;
2. rows meet the number of their key; what is left are ties. A window over the
   other order columns takes the first of them. AQE broadcasts the numbers of few
   keys, so that the rows are not shuffled; of many keys they are shuffled
   by key once, and a key's hot rows were filtered before the window sorts them.

NULL is the least value, as in an ascending order of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DataType, DateType, IntegerType, LongType, ShortType, StructType, TimestampNTZType,
                               TimestampType)

from cadence.operators.ordinal import join_null_safe

#: Widths in bits of the types that a code can hold, and their least value.
_BITS = {BooleanType: 1, ByteType: 8, ShortType: 16, IntegerType: 32, DateType: 32, LongType: 64, TimestampNTZType: 64, TimestampType: 64}
_BIGINT_BITS, _DECIMAL_BITS = 63, 126


def _number(c: Column, kind: DataType) -> Column:
    """The value as an integer in the same order."""
    if isinstance(kind, BooleanType):
        return c.cast("int")
    if isinstance(kind, DateType):
        return F.unix_date(c)
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    return c


def _flat(order: list[Column], schema: StructType) -> list[tuple[Column, DataType]]:
    """Order columns with their types; the fields of a struct one by one."""
    out = []
    for c, f in zip(order, schema.fields):
        if isinstance(f.dataType, StructType):
            out += _flat([c.getField(x) for x in f.dataType.names], f.dataType)
        else:
            out.append((c, f.dataType))
    return out


def order_code(columns: list[tuple[Column, DataType]]) -> tuple[Column | None, int]:
    """(code, how many of the leading columns it holds); the code sorts like these columns, NULL first.

    A column takes its width and, for NULL, the value below the least one.
    """
    taken, bits = [], 0
    for c, kind in columns:
        width = _BITS.get(type(kind))
        if width is None or bits + width + 1 > _DECIMAL_BITS:
            break
        bits += width + 1
        taken.append((c, kind, width))
    if not taken:
        return None, 0
    to = "bigint" if bits <= _BIGINT_BITS else "decimal(38,0)"
    code: Column | None = None
    for c, kind, width in taken:
        low = 0 if isinstance(kind, BooleanType) else -(1 << (width - 1))
        if to == "bigint":
            step = F.coalesce(_number(c, kind).cast(to) - F.lit(low - 1), F.lit(0).cast(to))
            code = step if code is None else F.shiftleft(code, width + 1).bitwiseOR(step)
        else:
            step = F.coalesce((_number(c, kind).cast("decimal(20,0)") - F.lit(str(low - 1)).cast("decimal(20,0)")).cast(to), F.lit(0).cast(to))
            code = step if code is None else (code * F.lit(str(1 << (width + 1))).cast("decimal(20,0)") + step).cast(to)
    return code.cast(to), len(taken)


def ends_per_key(df: DataFrame, keys, order: list, first: list[str] = (), last: list[str] = ()) -> DataFrame:
    """One row per key: the columns ``first`` of its first row in ``order`` and ``last`` of its last one.

    Columns of ``order`` are names, expressions or structs. Rows that are equal in
    all of them are told apart by a hash of what is taken, so that the picks
    do not depend on the run. NULL keys are equal. An empty table gives none.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    given = [F.col(c) if isinstance(c, str) else c for c in order]
    flat = _flat(given, df.select(*[c.alias(f"o{i}") for i, c in enumerate(given)]).schema)
    code, held = order_code(flat)
    taken = list(dict.fromkeys([*first, *last]))
    ties = [f"__t{i}" for i in range(len(flat) - held)]
    rows = df.select(*keys, *taken, *[c.alias(t) for t, (c, _) in zip(ties, flat[held:])],
                     (code if code is not None else F.lit(0).cast("bigint")).alias("__code"))
    if code is not None:
        ends = [f("__code") for f, cols in ((F.min, first), (F.max, last)) if cols] or [F.min("__code")]
        best = rows.groupBy(*keys).agg(*[e.alias(f"__end{i}") for i, e in enumerate(ends)])
        if len(ends) > 1:
            best = best.select(*keys, F.explode(F.array_distinct(F.array("__end0", "__end1"))).alias("__code"))
        else:
            best = best.withColumnRenamed("__end0", "__code")
        rows = join_null_safe(rows, best, [*keys, "__code"])
    if taken:
        rows = rows.withColumn("__tie", F.xxhash64(*taken))
    whole = Window.partitionBy(*keys).orderBy("__code", *ties, *(["__tie"] if taken else []))
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("__rn", F.row_number().over(whole))
    for name, cols, pick in (("__first", first, F.first), ("__last", last, F.last)):
        if cols:
            out = out.withColumn(name, pick(F.struct(*cols)).over(every))
    out = out.where("__rn = 1")
    return out.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in first], *[F.col(f"__last.{c}").alias(c) for c in last if c not in first])


def latest_per_key(df: DataFrame, keys, order: list, cols: list[str] | None = None, last: bool = True) -> DataFrame:
    """One row per key: ``cols`` (all other columns by default) of its last row in ``order``, or of its first one."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in (df.columns if cols is None else cols) if c not in keys]
    return ends_per_key(df, keys, order, **{"last" if last else "first": cols})
