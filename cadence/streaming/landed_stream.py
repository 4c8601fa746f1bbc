"""Landed files as a stream: each micro-batch is merged into the stored table.

The original imports in batches; here new landed JSON files are picked up by
Structured Streaming and every micro-batch is applied with the table's write
rule (upsert / insert-ignore).

A table is BUCKETS hash buckets of its key. A batch rewrites the buckets that it
touches, into a folder of its own, and publishes a new manifest: one row per
bucket with the folder of its data, and one per stream with the last epoch
applied. Manifests are numbered folders; the highest one with Spark's _SUCCESS
marker is the table. They are listed through Spark's file system API, so the
table may lie on any store, and old data stays readable until it is cleaned.

A manifest is never overwritten: of two streams that build the same number, the
second one finds it taken, reads the table again and merges its batch into
that. (The store has to refuse a folder that exists, as Spark's ``error`` mode
asks it to; between that look and the first file lies a moment that only a
table format with commits of its own closes.)

A replayed epoch is recognised by (query id, epoch) in the manifest. The query
id lives in the stream's checkpoint: after a reset of the checkpoint the id is
new, all landed files come again and are merged again, so nothing is lost. The
checkpoint itself lives under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import ensure_checkpoint_dir

#: Buckets of a table; fixed when the table is first written.
BUCKETS = 64
MANIFEST = "bucket int, path string, stream string, epoch bigint"


def manifest_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published manifests of the table at ``root``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_manifest")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> list:
    """Rows of a manifest, by default the newest: at most BUCKETS buckets and a row per stream."""
    if version is None:
        version = (manifest_versions(spark, root) or [0])[-1]
    return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/_manifest/v={version}").collect() if version else []


def _read_buckets(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    paths = sorted({f"{r.path}/bucket={r.bucket}" for r in rows if r.path})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table as the newest manifest has it."""
    return _read_buckets(spark, read_manifest(spark, root), schema)


def merge_stream(spark: SparkSession, landed_dir: str, landed_schema: str, table_root: str, table_schema: str,
                 merge: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], name: str = "landed",
                 available_now: bool = True):
    """Start a stream that applies ``merge(current rows, batch)`` per micro-batch
    to the buckets of ``keys`` that the batch touches. Returns the query."""
    root = table_root.rstrip("/")
    started, query_id = threading.Event(), []
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def apply(batch: DataFrame, epoch: int) -> None:
        started.wait()
        stream = query_id[0]
        batch = batch.persist()
        try:
            touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # BUCKETS numbers at most
            while not _publish(batch, touched, stream, epoch):
                pass
        finally:
            batch.unpersist()

    def _publish(batch: DataFrame, touched: set, stream: str, epoch: int) -> bool:
        """Merge into the newest manifest and publish the next; False when another stream has published meanwhile."""
        version = (manifest_versions(spark, root) or [0])[-1] + 1
        rows = read_manifest(spark, root, version - 1)
        if any(r.stream == stream and r.epoch >= epoch for r in rows if r.stream):
            return True  # replay of an applied epoch
        path = f"{root}/data/{uuid.uuid4().hex}"
        if touched:
            current = _read_buckets(spark, [r for r in rows if r.path and r.bucket in touched], table_schema)
            merge(current, batch).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
        table = [(r.bucket, r.path, None, None) for r in rows if r.path and r.bucket not in touched]
        table += [(b, path, None, None) for b in sorted(touched)]
        streams = [(None, None, r.stream, r.epoch) for r in rows if r.stream and r.stream != stream] + [(None, None, stream, epoch)]
        try:
            spark.createDataFrame(table + streams, MANIFEST).coalesce(1).write.mode("error").json(f"{root}/_manifest/v={version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return False
        return True

    reader = spark.readStream.schema(landed_schema).option("multiLine", True).json(landed_dir)
    writer = reader.writeStream.foreachBatch(apply).option(
        "checkpointLocation", f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    query_id.append(str(query.id))
    started.set()
    return query
