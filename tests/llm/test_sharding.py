import zlib
from collections import Counter, defaultdict

from cadence.llm.sharding import SPAN, assign_shards, jump_hash
from pyspark.sql import functions as F


def paper_hash(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_same_as_paper(spark):
    keys = list(range(300)) + [-1, -2, 2**63 - 1, -(2**63), 10**15 + 7]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 1000):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: paper_hash(k, n) for k in keys}


def test_rows_and_slots(docs_of):
    rows = [(i, "x" * (i % 7) + "é") for i in range(500)] + [(7, "same")] * 300 + [(None, None), (None, None), (3, "")]
    out = assign_shards(docs_of(rows)).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    moved = sum(r.grown_shard == 16 for r in out if r.doc_id != 7)
    assert 0 < moved < 100


def test_empty_text_keys_and_extra_columns(spark, docs_of):
    assert assign_shards(docs_of([])).count() == 0
    df = docs_of([(1, "a")]).selectExpr("cast(doc_id as string) as doc_id", "text", "1 as shard", "2 as slot", "3 as cell")
    r = assign_shards(df).first()
    assert (r.doc_id, r.slot) == ("1", 0) and 0 <= r.shard < 16


def test_many_equal_rows_are_unrolled_in_many_tasks(spark):
    n = 5 * SPAN + 7
    df = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    out = assign_shards(df.unionByName(df.limit(1).withColumn("text", F.lit("other"))))
    slots = out.groupBy("shard").agg(F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert [(r.d, r.a, r.b) for r in slots] == [(n + 1, 0, n)]
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 4 * SPAN
