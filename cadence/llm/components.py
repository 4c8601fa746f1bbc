"""Connected components of a table of links, by alternating star contraction.

Each round every node hangs itself and its larger neighbours below its smallest
neighbour (large star), then its smaller neighbours below the smallest (small
star), until the links are flat; the number of rounds grows with the logarithm of
the longest path. Rounds are grouped aggregations and joins of links, staged in
the shared folder; a node with very many links is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import stage, unstage


#: Links that one task writes; fewer tasks than shuffle partitions do for the few links of most rounds.
LINKS_A_TASK = 1_000_000


def _stars(both: DataFrame, larger: bool, tasks: int) -> DataFrame:
    """Links (u, v) -> staged links to the smallest of u and its neighbours; ``both`` has u with the neighbours that count."""
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "c").alias("m")).coalesce(tasks), "least")
    hung = both.join(least, F.col("u") == F.col("c"))
    hung = (hung.where("v > u") if larger else hung).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        hung = hung.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    out = stage(hung.where("u <> v").distinct().coalesce(tasks), "large-star" if larger else "small-star")
    unstage(least)
    return out


def _flat(down: DataFrame) -> bool:
    """Every node hangs below one other, and that below none: the links are the components."""
    seen = (down.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
            .unionByName(down.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
            .groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")))
    return seen.where("below > 1 or (below = 1 and above = 1)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (two columns of numbers): the root is the smallest node it is linked to.

    Loops and repeated links do no harm; without links the result is empty.
    """
    a, b = links.columns
    down = stage(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    tasks = max(2 * down.sparkSession.sparkContext.defaultParallelism, down.count() // LINKS_A_TASK)

    while not _flat(down):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True, tasks)
        unstage(down)
        down = _stars(large, False, tasks)
        unstage(large)
    nodes = down.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    out._staged_path = down._staged_path
    return out
