"""Sharding by jump consistent hashing, in Spark SQL functions only.

Jump consistent hashing (Lamping and Veach, 2014) maps a 64-bit key to a shard
without a ring table: a 64-bit linear congruential generator seeded with the
key draws the next shard count at which the key moves, until that lies beyond
the number of shards. With one more shard a key either stays or moves into the
new one, so only the necessary fraction of rows moves.

Null and edge cases: a null key counts as key 0; a non-integer key is hashed
to 64 bits first; a null text has no bytes (size 1); an empty table gives an
empty result; repeated rows are each placed and get slots of their own; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Multiplier of the generator in the paper, as two halves of 32 bits.
_M = 2862933555777941757
_M_HI, _M_LO = _M >> 32, _M & 0xFFFFFFFF
_MASK = 0xFFFFFFFF

#: Cells that the rows of a shard are numbered in; a cell, not a shard, is the unit of one task.
CELLS = 4096
#: Equal rows that one row is unrolled into at once; beyond, their spans are spread over tasks.
SPAN = 16384


def _next_state(key: Column) -> Column:
    """key * M + 1 modulo 2^64, in 16- and 32-bit limbs so that no product or sum overflows (ANSI mode)."""
    mask = F.lit(_MASK).cast("long")
    lo, hi = key.bitwiseAND(mask), F.shiftrightunsigned(key, 32)
    lo0, lo1 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(lo, 16)
    hi0, hi1 = hi.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(hi, 16)
    m_lo, m_hi = F.lit(_M_LO).cast("long"), F.lit(_M_HI).cast("long")
    p0, p1 = lo0 * m_lo, lo1 * m_lo
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(p1, 16)
            + (lo * m_hi).bitwiseAND(mask)
            + (hi0 * m_lo).bitwiseAND(mask)
            + F.shiftleft((hi1 * m_lo).bitwiseAND(F.lit(0xFFFF)), 16))
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit key. At most ``shards`` jumps are ever drawn."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(acc: Column, _: Column) -> Column:
        # `at` is the shard so far, `to` the next shard count at which the key moves
        state = _next_state(acc["state"])
        r = F.lit(float(1 << 31)) / (F.shiftrightunsigned(state, 33) + F.lit(1)).cast("double")
        to = F.least(F.floor((acc["to"] + F.lit(1)).cast("double") * r), F.lit(shards).cast("long"))
        return F.when(acc["to"] >= F.lit(shards), acc).otherwise(
            F.struct(acc["to"].alias("at"), to.alias("to"), state.alias("state")))

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"),
                     key.cast("long").alias("state"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["at"].cast("int"))


def shard_key(df: DataFrame, name: str) -> Column:
    """64-bit key of a column: integers as they are, anything else hashed; null is 0."""
    if isinstance(df.schema[name].dataType, IntegralType):
        return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    return F.when(F.col(name).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(name))


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 1, ``slot`` a gapless number
    from 0 inside the shard, ``grown_shard`` the shard with one more shard.

    Slots need no task per shard: equal rows are counted first (map-side
    combine, so a key that holds a third of all rows is one row), a shard is
    split into CELLS cells by hash, rows are numbered inside cells and the
    sizes of the cells, at most shards * CELLS numbers, are summed up. Counted rows
    are unrolled in spans of SPAN that lie in tasks of their own.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    k = shard_key(df, key)
    rows = df.select(
        F.col(key).alias("doc_id"),
        k.alias("key"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + F.lit(1)).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select(
        "*", jump_hash(F.col("key"), shards).alias("shard"), jump_hash(F.col("key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(CELLS)).alias("cell"))
    cells = placed.groupBy("shard", "cell").agg(F.sum("n").alias("cell_rows"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    first = placed.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    spans = first.join(cells, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("base") + F.col("first")).alias("slot"), "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1), F.lit(SPAN).cast("long"))).alias("from"))
    # the spans of one row go to many tasks; their number is given, as a span is a small row that adaptive plans would gather
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spans.repartition(tasks, "slot", "from")
    return (spread.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + F.lit(SPAN), F.col("n")) - F.lit(1))))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("i")).alias("slot"), "grown_shard"))


def op8_jump_hash_sharding(spark, sf_dir):
    """All ``documents`` into 16 shards under the law `key` (see ``assign_shards``)."""
    from cadence.llm.common import documents

    out = assign_shards(documents(spark, sf_dir).select("doc_id", "text"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
