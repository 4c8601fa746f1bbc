"""Merkle dataset manifest by checkpoint and recompute.

Every row is a leaf; the leaves of a group (a language) are the lowest level of
a tree of hashes, and the roots of the groups are the leaves of the tree that
gives the root of the dataset. Only the nodes of every STRIDE-th level are
written. A proof needs siblings of all levels: each aligned subtree of
2^STRIDE stored nodes is hashed again from them, hands out the siblings of its
nodes from top to bottom, and forgets the levels between.

Scale: what moves are digests, never texts. Places of leaves come from range
partitions and their counts (``running``), so a group that holds a third of all
rows is cut into parts like all others; a task sees subtrees of 256 nodes.

Null and edge cases: a null field is marked, apart from every value; a null
group comes first; null ids come first in their group; rows that repeat an id
are ordered by their digest; identical rows are leaves each; empty and long
texts are hashed whole; a group of one leaf is its own subroot; one group's
subroot is the root; an empty table has no rows and no root; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage
from cadence.llm.running import running

#: Levels between two that are written; a subtree has 2^STRIDE nodes below.
STRIDE = 8
#: Subtrees whose proofs a task holds at once.
SUBTREES = 64
#: The place of the running digest among the siblings of a step of a proof.
HERE = ":"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _up(level: list[str]) -> list[str]:
    return [hashlib.sha256((level[i] + (level[i + 1] if i + 1 < len(level) else "")).encode()).hexdigest() for i in range(0, len(level), 2)]


def _steps(height: int, stride: int) -> int:
    return min(stride, height)


def _climb(stride: int):
    """Subtrees -> their top nodes, one stored level further up."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tops = []
            for height, digests in zip(batch["height"], batch["digest"]):
                level = list(digests)
                for _ in range(_steps(int(height), stride)):
                    level = _up(level)
                tops.append(level[0])
            yield pd.DataFrame({"grp": batch["grp"], "i": batch["block"], "digest": tops})
    return run


def _expand(stride: int, top: bool):
    """Subtrees with the proof of their top node -> their stored nodes with theirs, a few subtrees at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SUBTREES):
                batch = whole.slice(first, SUBTREES)
                nodes = batch.column("nodes")
                flat, sizes = nodes.flatten(), pc.list_value_length(nodes).to_pylist()
                digests, at, paths, tops = flat.field("digest").to_pylist(), 0, [], []
                for size, height, rest in zip(sizes, batch.column("height").to_pylist(), batch.column("path").to_pylist()):
                    level, levels = digests[at:at + size], []
                    for _ in range(_steps(height, stride)):
                        levels.append(level)
                        level = _up(level)
                    for k in range(size):
                        path = []
                        for j, nodes_of_level in enumerate(levels):
                            i = k >> j
                            other = nodes_of_level[i ^ 1] if i ^ 1 < len(nodes_of_level) else ""
                            path.append(HERE + other if i % 2 == 0 else other + HERE)
                        paths.append(path + rest)
                    tops.append(level[0])
                    at += size
                of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                own = pa.array(tops, pa.string())
                out = {"grp": batch.column("grp").take(of), "i": flat.field("i"), "digest": flat.field("digest"), "row": flat.field("row"),
                       "path": pa.array(paths, pa.list_(pa.string())), "subroot": (own if top else batch.column("subroot")).take(of),
                       "root": (own if top else batch.column("root")).take(of)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
    return run


@dataclass
class Tree:
    """Stored levels of one tree a group: (grp, i, digest, row); ``row`` is what the caller keeps of a leaf."""
    levels: list[DataFrame]
    heights: DataFrame
    stride: int

    def _subtrees(self, k: int) -> DataFrame:
        """Aligned subtrees of the k-th stored level: grp, block, nodes in order, levels still to climb."""
        blocks = self.levels[k].groupBy("grp", F.shiftright("i", self.stride).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("i", "digest", "row"))).alias("nodes"))
        return blocks.join(self.heights, "grp").withColumn("height", F.greatest(F.col("full_height") - k * self.stride, F.lit(0))).drop("full_height")

    def climb(self) -> DataFrame:
        """The next stored level."""
        tops = self._subtrees(len(self.levels) - 1).select("grp", "block", "height", "nodes.digest")
        return tops.mapInPandas(_climb(self.stride), "grp string, i long, digest string").withColumn("row", F.lit(None).cast("boolean"))

    def proofs(self, tops: DataFrame | None = None) -> DataFrame:
        """(grp, i, digest, row, path, subroot, root) of every leaf; ``tops`` has what goes on above a group: grp, path, subroot, root.

        Without ``tops`` the tree's own top is subroot and root.
        """
        out, highest = None, len(self.levels) - 2
        for k in range(highest, -1, -1):
            blocks = self._subtrees(k)
            if k == highest:
                rest = blocks.join(tops, "grp") if tops is not None else blocks.withColumns(
                    {"path": F.array().cast("array<string>"), "subroot": F.lit(""), "root": F.lit("")})
            else:
                above = out.select(F.col("grp").alias("_g"), F.col("i").alias("_i"), "path", "subroot", "root")
                rest = blocks.join(above, (F.col("grp") == F.col("_g")) & (F.col("block") == F.col("_i")))
            row = self.levels[k].schema["row"].dataType.simpleString()
            out = rest.select("grp", "height", "nodes", "path", "subroot", "root").mapInArrow(
                _expand(self.stride, tops is None and k == highest),
                f"grp string, i long, digest string, row {row}, path array<string>, subroot string, root string")
            if k:
                out = stage(out, "paths")
        return out


def _grow(leaves: DataFrame, stride: int) -> Tree:
    """Stored levels above ``leaves`` (grp, i, digest, row); the last has one node a group."""
    n = F.max("i") + 1
    height = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))  # levels until one node is left
    heights = stage(leaves.groupBy("grp").agg(height.alias("full_height")).coalesce(1), "heights")
    tallest = heights.agg(F.max("full_height")).first()[0] or 0
    tree = Tree([leaves], heights, stride)
    for _ in range(max(1, -(-tallest // stride))):
        tree.levels.append(stage(tree.climb(), "level"))
    return tree


@dataclass
class Manifest:
    """Stored nodes of the groups' trees and of the tree of their subroots."""
    groups: Tree
    forest: Tree

    def root(self) -> str | None:
        """The digest of the dataset; None for an empty one."""
        top = self.forest.levels[-1].first()
        return top.digest if top else None

    def subroots(self) -> DataFrame:
        """(grp, digest) of each group; ``grp`` is empty for null, else ``=`` and the value."""
        return self.groups.levels[-1].select("grp", "digest")

    def proofs(self) -> DataFrame:
        """Per leaf: the columns kept by ``build``, leaf, subroot, root, path.

        ``path`` has a step a level: the siblings, with ``:`` where the digest so
        far belongs, so that a proof folds by ``sha2(replace(step, ':', digest))``.
        """
        tops = stage(self.forest.proofs().select(F.col("row").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "tops")
        return self.groups.proofs(tops).select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def build(df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id",
          keep: dict[str, Column] | None = None, stride: int = STRIDE) -> Manifest:
    """The manifest of ``df``: leaves over ``fields``, ordered by ``order`` in each ``group``.

    ``keep`` names expressions over ``df`` that come back with the proofs,
    beside ``order``; they have to be of types that can be sorted.
    """
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    row = F.struct(F.col(order).alias(order), *[e.alias(c) for c, e in (keep or {}).items()])
    leaves = stage(df.select(name.alias("grp"), F.col(order).alias("by"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
                             row.alias("row"), F.monotonically_increasing_id().alias("nth")), "leaves")
    groups = _grow(running(leaves, ["grp"], ["by", "digest", "nth"], {"i": ("*", "sum")}, "placed").select("grp", "i", "digest", "row"), stride)
    tops = running(groups.levels[-1].select("grp", "digest"), [], ["grp"], {"i": ("*", "sum")}, "subroots")
    return Manifest(groups, _grow(tops.select(F.lit("").alias("grp"), "i", "digest", F.col("grp").alias("row")), stride))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.replace(step, F.lit(HERE), acc), 256))


def op12_merkle_manifest(spark, sf_dir):
    """Root, subroots and the proof of every row of ``documents``; of rows whose id's crc32 is a multiple of 7, n_chars is tampered with."""
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    forged = F.when(tampered & F.col("n_chars").isNotNull(),
                    leaf_digest([longer if f == "n_chars" else F.col(f) for f in FIELDS]))
    proofs = build(docs, keep={"forged": forged}).proofs()
    siblings = F.sha2(F.replace(F.array_join("path", ""), F.lit(HERE), F.lit("")), 256)
    out = proofs.select("doc_id", "leaf", "subroot", "root", siblings.alias("proof_sha256"),
                        fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a text of digits or other one-byte characters, for DuckDB.
CRC32_SQL = """(xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({0}) + 1), lambda i: ord(({0})[i])::bigint)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295))"""


def _field_sql(value: str) -> str:
    return f"case when ({value}) is null then '-' else octet_length(encode(({value})::varchar))::varchar || ':' || ({value})::varchar end"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


ORACLE_SQL = f"""
with recursive leaves as (
  select doc_id, lang, {_leaf_sql("n_chars")} as leaf, {_leaf_sql("n_chars + 1")} as changed, {CRC32_SQL.format("doc_id::varchar")} % 7 = 0 as tampered
  from documents),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves),
tree(lang, lvl, i, n, d) as (
  select lang, 0, i, n, leaf from placed
  union all
  select lang, lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' order by i)) from tree where n > 1 group by lang, lvl, i // 2),
subroots as (
  select lang, d, lvl as top, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1),
forest(lvl, i, n, d) as (
  select 0, i, n, d from subroots
  union all
  select lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' order by i)) from forest where n > 1 group by lvl, i // 2),
steps as (  -- per leaf and level: the sibling and the side of the digest so far
  select p.doc_id, p.leaf, s.lang, t.lvl, t.i % 2 as odd, coalesce(o.d, '') as sibling, p.i as place
  from placed p join subroots s on s.lang is not distinct from p.lang
  join tree t on t.lang is not distinct from p.lang and t.i = p.i >> t.lvl and t.n > 1
  left join tree o on o.lang is not distinct from t.lang and o.lvl = t.lvl and o.i = xor(t.i, 1)
  union all
  select p.doc_id, p.leaf, s.lang, s.top + f.lvl, f.i % 2, coalesce(o.d, ''), p.i
  from placed p join subroots s on s.lang is not distinct from p.lang
  join forest f on f.i = s.i >> f.lvl and f.n > 1
  left join forest o on o.lvl = f.lvl and o.i = xor(f.i, 1)),
paths as (
  select lang, place, list({{'odd': odd, 'd': sibling}} order by lvl) as path from steps group by lang, place),
folded as (
  select p.*, path, s.d as subroot, (select d from forest where n = 1) as root,
    list_reduce(list_concat([{{'odd': 0, 'd': case when tampered then changed else leaf end}}], coalesce(path, [])),
      lambda a, b: {{'odd': 0, 'd': sha256(case when b.odd = 1 then b.d || a.d else a.d || b.d end)}}).d as folded_root
  from placed p
  join subroots s on s.lang is not distinct from p.lang
  left join paths q on q.lang is not distinct from p.lang and q.place = p.i)
select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.d), 'string_agg', ''), '')) as proof_sha256,
  folded_root, folded_root = root as verified
from folded
"""
