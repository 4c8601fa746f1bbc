"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into blocks of BLOCK bytes. Blocks are sorted and
named by integers: equal blocks get equal names, different blocks different
names. Then the names of adjacent blocks are paired and the pairs named the
same way, until one name is left: after level n two texts of up to 2^n blocks
are equal exactly when their names are. Names are ranks of sorted content, not
hashes, so the identity is free of collisions.

Skew: a value with over 1/MAX_HOT of all rows (copies of one text, a common
first block) is found by a count over all rows; there are fewer than MAX_HOT
such values, they are named first and attached by a broadcast of that bounded
table, and their rows are spread over all tasks. The others are named by rank
inside hash buckets, so no task sees more than its buckets.

Null and edge cases: a null text counts as empty; empty texts are equal to each
other; rows with the same id are told apart by content; identical rows stay
rows of one group; a null id sorts last among ties; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import documents, hot_values, row_key, stage

#: Bytes in a block.
BLOCK = 4096
#: Hash buckets that values are sorted in; each bucket is sorted by one task.
BUCKETS = 1 << 16
#: The white space that does not count.
SPACE = " \t\n\x0b\x0c\r"


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def name_values(rows: DataFrame, value: list[str], spread_by: str) -> DataFrame:
    """Replace the columns ``value`` by one integer ``name``: equal values, equal names; others, other names.

    Names are ranks of the sorted values: rank in the bucket * BUCKETS + bucket,
    and negative ranks for hot values.
    """
    rows = rows.withColumn("_h", F.xxhash64(*value))
    hot_h = hot_values(rows, ["_h"]).select("_h")
    # the values behind the hot hashes: grouped with map-side combine, fewer than MAX_HOT but for hash collisions
    hot = rows.join(F.broadcast(hot_h), "_h", "left_semi").groupBy(*value).agg(F.count(F.lit(1)).alias("_n"))
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema).select(
        *[F.col(v).alias(f"_hot_{v}") for v in value],
        (-F.row_number().over(Window.orderBy(*value))).cast("long").alias("_hot_name"))
    same = F.lit(True)
    for v in value:
        same = same & F.col(v).eqNullSafe(F.col(f"_hot_{v}"))
    rows = rows.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{v}" for v in value])
    is_hot = F.col("_hot_name").isNotNull()
    rows = rows.withColumn("_bucket", F.pmod(F.when(is_hot, F.xxhash64(spread_by)).otherwise(F.col("_h")), F.lit(BUCKETS)))
    for v in value:  # a hot value need not travel any further
        rows = rows.withColumn(v, F.when(~is_hot, F.col(v)))
    in_bucket = Window.partitionBy("_bucket", is_hot).orderBy(*value)
    rank = (F.dense_rank().over(in_bucket) - F.lit(1)).cast("long") * F.lit(BUCKETS) + F.col("_bucket")
    return rows.withColumn("name", F.coalesce(F.col("_hot_name"), rank)).drop("_h", "_hot_name", "_bucket", *value)


def text_identities(rows: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """``key``, ``level``, ``name``: rows have equal (level, name) exactly when their texts are equal.

    ``key`` must be unique up to equal texts.
    """
    data = F.col(text).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(block))).cast("int")
    blocks = rows.select(key, n.alias("blocks"), F.posexplode(F.transform(
        F.sequence(F.lit(0), n - F.lit(1)),
        lambda i: F.substring(data, i * F.lit(block) + F.lit(1), F.lit(block)))).alias("idx", "block"))
    named = stage(name_values(blocks, ["block"], key).select(key, "blocks", "idx", "name"), "block-names")
    most = named.agg(F.max("blocks")).first()[0] or 1
    done = named.where("blocks = 1").select(key, F.lit(0).alias("level"), "name")
    level, open_rows = 0, named.where("blocks > 1")
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        right = F.col("idx") % 2 == 1
        pairs = open_rows.groupBy(key, ((F.col("blocks") + 1) / 2).cast("int").alias("blocks"),
                                  (F.col("idx") / 2).cast("int").alias("idx")).agg(
            F.max(F.when(~right, F.col("name"))).alias("left"), F.max(F.when(right, F.col("name"))).alias("right"))
        named = stage(name_values(pairs, ["left", "right"], key), "pair-names")
        done = done.unionByName(named.where("blocks = 1").select(key, F.lit(level).alias("level"), "name"))
        open_rows = named.where("blocks > 1")
    return done


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``df``.

    Of equal texts (white space aside) the row with the most code points stays,
    then the one with the smallest id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), text).alias("key"),
                     normalise(F.col(text_col)).alias("norm"), F.length(text).alias("chars"))
    # equal keys have equal texts but for a 64-bit collision inside one id; chars rides along
    names = text_identities(base.select("key", "norm"), "key", "norm").distinct()
    facts = base.select("doc_id", "key", "chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    flat = facts.select("doc_id", F.col("key.id").alias("k1"), F.col("key.h").alias("k2"), "chars", "text_sha256")
    names = names.select(F.col("key.id").alias("n1"), F.col("key.h").alias("n2"), "level", "name")
    rows = stage(flat.join(names, F.expr("k1 <=> n1 and k2 = n2"))
                 .select("doc_id", "chars", "text_sha256", "level", "name"), "identities")
    first = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"))
    groups = stage(rows.groupBy("level", "name").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = rows.join(groups, ["level", "name"])
    return out.select(
        "doc_id", F.col("first.d").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("chars") == -F.col("first.c"))).alias("kept"),
        "text_sha256")


def op6_block_naming_dedup(spark, sf_dir):
    """Every row of ``documents`` with the row of its group of equal texts that stays."""
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
r as (
  select doc_id, norm, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id
  from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
"""
