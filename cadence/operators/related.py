"""First / last related row (J-04, J-05) as aggregate + equi join.

The original uses ``JOIN LATERAL (… ORDER BY ts LIMIT 1)``. Here the related
table is reduced to one row per parent with a partial aggregate (``min`` /
``max``), then joined on the parent key: a parent with millions of children
becomes one row before the shuffle, so a hot parent cannot skew the join.

With ``prefilter`` the related table is first cut to the parents at hand by a
bit filter: the hashes of their keys set bits in FILTER_WORDS words, at most that many
rows whatever the data, which are broadcast; a related row whose bit is not set
belongs to no parent and is dropped where it is read, before anything is shuffled.
The join that follows is exact, so rows that share a bit by chance do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Words of 64 bits in the filter: 2^24 bits, at most 2^18 rows of a broadcast.
FILTER_WORDS = 1 << 18


def related_only(other: DataFrame, other_key: str, parents: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """Rows of ``other`` whose key may be one of the ``parents``; rows of no parent mostly drop, others never."""
    integral = all(df.schema[k].dataType.typeName() in ("byte", "short", "integer", "long") for df, k in ((other, other_key), (parents, key)))
    same = "bigint" if integral else "string"  # equal keys of two types hash alike

    def word(c):
        return F.pmod(F.xxhash64(c.cast(same)), F.lit(words)).cast("int")

    def bit(c):
        return F.pmod(F.xxhash64(c.cast(same), F.lit(1)), F.lit(64)).cast("int")

    k = F.col(key)
    bits = parents.where(k.isNotNull()).groupBy(word(k).alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(k))).alias("__bits"))
    o = F.col(other_key)
    met = other.join(F.broadcast(bits), word(o) == F.col("__word"), "inner")
    return met.where(F.getbit("__bits", bit(o)) == 1).drop("__word", "__bits")


def _reduce(other: DataFrame, other_key: str, ts: str, where, pick: str, nulls: str) -> DataFrame:
    o = other.where(where) if where is not None else other
    t = F.col(ts)
    if pick == "first":
        # ASC puts NULL last: the earliest non-NULL time; all NULL → NULL
        v = F.min(t)
    elif nulls == "reference":
        # DESC puts NULL first in PostgreSQL: any undated row wins → NULL
        v = F.when(F.max(t.isNull().cast("int")) == 1, F.lit(None).cast(other.schema[ts].dataType)).otherwise(F.max(t))
    elif nulls == "ignore":
        v = F.max(t)
    else:
        raise ValueError(nulls)
    return o.groupBy(F.col(other_key).alias("__k")).agg(v.alias("__related_ts"))


def first_related(df: DataFrame, other: DataFrame, on: tuple[str, str], ts: str, where=None,
                  name: str = "first_ts", prefilter: bool = False) -> DataFrame:
    """Inner join of ``df`` with the earliest ``ts`` of its related rows;
    parents without related rows drop."""
    key, other_key = on
    if prefilter:
        other = related_only(other, other_key, df.select(key), key)
    r = _reduce(other, other_key, ts, where, "first", "ignore")
    return df.join(r, df[key] == r["__k"], "inner").drop("__k").withColumnRenamed("__related_ts", name)


def last_related(df: DataFrame, other: DataFrame, on: tuple[str, str], ts: str, where=None,
                 nulls: str = "reference", name: str = "last_ts", prefilter: bool = False) -> DataFrame:
    """Inner join with the latest ``ts`` of the related rows matching ``where``.

    ``nulls='reference'`` mirrors ``ORDER BY ts DESC LIMIT 1`` in PostgreSQL: an
    undated related row sorts first and makes the value NULL. ``'ignore'`` takes
    the latest dated row.
    """
    key, other_key = on
    if prefilter:
        other = related_only(other, other_key, df.select(key), key)
    r = _reduce(other, other_key, ts, where, "last", nulls)
    return df.join(r, df[key] == r["__k"], "inner").drop("__k").withColumnRenamed("__related_ts", name)
