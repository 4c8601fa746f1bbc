"""Helpers shared by the training-data operators.

* ``stage`` cuts lineage through a table written to the shared folder that the
  session names in ``spark.checkpoint.dir``; a folder of its own is made only
  in a local session without that setting (tests).
* ``row_key`` gives rows an identity that repeated or null ids cannot break.
* ``hot_values`` finds the few values that hold a large share of all rows; the
  result has at most ``MAX_HOT`` rows whatever the input, so it may be
  broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value is hot when it holds over 1/MAX_HOT of all rows, so there are fewer than MAX_HOT of them.
MAX_HOT = 500
#: Values with fewer rows than this are never worth spreading.
MIN_HOT = 256

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="cadence-llm-")
    return _LOCAL[app]


#: Spark setting that drops the shuffle files of a query when it has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, no recomputation, survives lost executors.

    The shuffle files behind the written table are dropped at once, so the disk
    holds the shuffles of one stage, not of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete the folder of a staged table that nothing will read again: all that was made from it has been written."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(id_col: Column, *content: Column) -> Column:
    """An identity that stays apart for rows with the same or a null id and different content."""
    return F.struct(id_col.alias("id"), F.xxhash64(*content).alias("h"))


def hot_values(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Values of ``cols`` that hold over 1/MAX_HOT of all rows (and over MIN_HOT rows): columns + ``n_rows``.

    Counted over all rows with map-side combine. Fewer than MAX_HOT rows by
    construction, so they are brought into the plan as literals and may be
    broadcast.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    hot = counts.where(F.col("n_rows") > F.greatest(F.lit(MIN_HOT), total.scalar() / F.lit(MAX_HOT)))
    return spark.createDataFrame(hot.collect(), hot.schema)
