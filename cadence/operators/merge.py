"""Write rules of the stored tables as DataFrame merges (K-01 … K-07).

Plain parquet has no row update, so each rule builds the next snapshot of a
table from the current one and a batch; the caller writes it (to a new path
or with ``mode('overwrite')``). Every rule needs a total arrival order for
the batch — the original applies rows one by one, last write wins.

All rules are joins on the key after the batch is reduced to one row per key
(``min_by`` / ``max_by``). Spark plans that as a sort aggregate: each task sorts its
part of the batch by key, reduces it there, and sends one row per key. A key
repeated a million times in a batch is one row per task before the shuffle. The
hash form (``latest.ends_per_key``) reads the batch twice and was slower here;
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order) -> Column:
    if isinstance(order, (list, tuple)):
        return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return F.col(order) if isinstance(order, str) else order


def upsert(target: DataFrame, batch: DataFrame, keys, order, update_cols) -> DataFrame:
    """Insert new keys; for existing keys overwrite only ``update_cols`` (K-01).

    Within the batch the first version of a key supplies the columns that are
    never updated and the last version the updatable ones. A stored NULL in a
    frozen column stays NULL (no ``coalesce``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = target.columns
    update_cols = [c for c in update_cols if c in cols]
    frozen = [c for c in cols if c not in keys and c not in update_cols]
    o = _order(order)
    aggs = [F.max_by(F.struct(*[F.col(c) for c in update_cols]), o).alias("__u")] if update_cols else []
    if frozen:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in frozen]), o).alias("__f"))
    b = batch.groupBy(*keys).agg(*aggs).withColumn("__in_b", F.lit(True))
    t = target.withColumn("__in_t", F.lit(True))
    j = t.join(b, keys, "full_outer")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("__in_b").isNotNull(), F.col(f"__u.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__in_t").isNotNull(), F.col(c)).otherwise(F.col(f"__f.{c}")).alias(c))
    return j.select(*out)


def _first_per_key(batch: DataFrame, keys, order) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.select(*keys).distinct()
    picked = batch.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), _order(order)).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def insert_ignore(target: DataFrame, batch: DataFrame, keys, order, nulls_collide: bool = True) -> DataFrame:
    """Insert batch rows whose key is not stored yet; the first batch row of a
    key wins (K-02). With ``nulls_collide=False`` a key containing NULL never
    matches anything — such rows are all inserted, as a unique index with a
    nullable column does (K-03)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    batch = batch.select(*target.columns, *([order] if isinstance(order, str) and order not in target.columns else []))
    if nulls_collide:
        fresh = _first_per_key(batch, keys, order)
        new = fresh.join(target.select(*keys), keys, "left_anti")
        return target.unionByName(new.select(*target.columns))
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    nullish = batch.where(any_null).select(*target.columns)
    keyed = batch.where(~any_null)
    fresh = _first_per_key(keyed, keys, order)
    stored = target.where(~any_null).select(*keys)
    new = fresh.join(stored, keys, "left_anti").select(*target.columns)
    return target.unionByName(new).unionByName(nullish)


def replace_by_key(target: DataFrame, batch: DataFrame, part_keys) -> DataFrame:
    """Delete every stored row whose ``part_keys`` occur in the batch, then
    insert the batch (K-04 per repository, K-05 per query). An empty batch
    changes nothing. With a partitioned table the same rule is a dynamic
    partition overwrite (``partitionOverwriteMode=dynamic``)."""
    part_keys = [part_keys] if isinstance(part_keys, str) else list(part_keys)
    present = batch.select(*part_keys).distinct()
    kept = target.join(present, part_keys, "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def update_found(target: DataFrame, details: DataFrame, keys, cols, order=None) -> DataFrame:
    """Overwrite ``cols`` of stored rows that have a detail row (K-07). Of
    several details of a key the last by ``order`` counts (without an order the
    greatest by value), so a stored row never fans out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = F.struct(*[F.col(c) for c in cols])
    last = details.groupBy(*keys).agg((F.max(values) if order is None else F.max_by(values, _order(order))).alias("__d"))
    d = last.select(*keys, *[F.col(f"__d.{c}").alias(f"__d_{c}") for c in cols]).withColumn("__hit", F.lit(True))
    j = target.join(d, keys, "left")
    return j.select(*[
        F.when(F.col("__hit").isNotNull(), F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in target.columns
    ])


def ensure_rows(target: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Get-or-create dimension rows (K-08): insert-ignore of distinct names."""
    return insert_ignore(target, names.select(key).distinct(), [key], key)
