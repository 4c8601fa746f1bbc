"""N-gram Jaccard join of texts with prefix trees; groups are connected components of the links.

Two texts link when den * |A and B| >= num * |A or B| for their sets of word
shingles (num / den = 90 / 100 by default). Sets are compared by 64-bit hashes.

1. Texts with equal sets are one node, the name of the set.
2. Candidates by pigeonhole: sets of up to H shingles that link differ in at
   most 2 * H * (den - num) / (den + num) shingles, so if the space of hashes is
   cut into more parts than that, some parts hold the same shingles in both. The
   number of parts leaves room for parts that are empty in both, which say
   nothing; a set with more empty parts than that names them as well. A set emits a row for each part, at the number of parts of its own
   size class and of the next larger one. Nodes that share a part form rough
   components; a shared passage alone does not make a whole part equal, so
   they stay small, and nothing but (part, node) rows is shuffled.
3. Every rough component is joined exactly by a prefix tree of its sets in one
   global order (shingles.PrefixTree). A component with more shingles than one
   task should hold (BLOCK) is first taken apart by the prefix filter, in the
   order of how many of its sets hold a shingle, and what is still too large is
   cut into blocks by size class and hash, and all
   pairs of blocks whose sizes can link are joined, each by a task of its own,
   so nothing is capped. A task hands on at most one link per node, those of a
   spanning forest.
4. Components of the links give each text its group.

Null and edge cases: null, empty and wordless texts have no shingles and link
with nothing; shorter texts than a shingle are one shingle; repeated rows and
ids belong to the group of their set; a null id never names a group unless all
its ids are null, and a text that occurs under null ids only links with equal
texts alone, as nodes come back to their texts by an id; an empty table gives an empty result; texts are read whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage, unstage
from cadence.llm.components import components
from cadence.llm.shingles import Links, PrefixTree, mix, rank_sets, set_name, shingle_set

SHINGLE = 3
NUM, DEN = 90, 100
#: Shingles that a block of a component may hold.
BLOCK = 250_000
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


@lru_cache
def size_classes(num: int, den: int, upto: int) -> np.ndarray:
    """Least sizes of the classes: a set links only with sets of its own and the neighbouring classes."""
    least = [1]
    while least[-1] <= upto:
        least.append(least[-1] * den // num + 1)
    return np.array(least, dtype=np.int64)


@lru_cache(maxsize=4096)
def part_edges(parts: int) -> np.ndarray:
    """Bounds that cut the space of hashes into equal parts."""
    return np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def parts_of_class(least: int, most: int, num: int, den: int) -> tuple[int, int]:
    """(parts, spare) for sets of ``least`` to ``most`` members: linked sets differ in parts - spare parts at most, so
    ``spare`` parts at least are equal. Some may be empty in both; spare is chosen above the number of empty parts of
    nearly all sets, so that an equal part that is not empty remains. (0, 0): only equal sets link."""
    differ = 2 * most * (den - num) // (den + num)
    if differ == 0:
        return 0, 0
    spare = 1
    for _ in range(3):
        parts = differ + spare
        empty = parts * exp(-least / parts)
        spare = 1 + ceil(empty + 4 * sqrt(empty)) if empty > 1e-3 else 1
    return differ + spare, spare


def part_names(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """64-bit names of the parts of a sorted set, for its size class and the next."""
    n = len(members)
    least = size_classes(num, den, 1 << (2 * n + 2).bit_length())
    own = int(np.searchsorted(least, n, side="right")) - 1
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(members ^ _SALT), dtype=np.uint64)])
        for c in (own, own + 1):
            parts, spare = parts_of_class(int(least[c]), int(least[c + 1]) - 1, num, den)
            if not parts:
                continue  # sets of this class link only when they are equal
            at = np.concatenate([[0], np.searchsorted(members, part_edges(parts)), [n]])
            content = sums[at[1:]] - sums[at[:-1]]
            label = np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)
            held = np.diff(at)
            names = mix(mix(content + held.astype(np.uint64)) + mix(label + _SALT))
            # with fewer empty parts than equal ones, an equal part that is not empty tells; else the empty ones have to
            out.append(names[held > 0] if (held == 0).sum() < spare else names)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def _sets(size: int, num: int, den: int):
    """Size, name and part names of the set of every text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                sets = [shingle_set(t, size) for t in part["text"]]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "n": [len(s) for s in sets],
                    "node": pd.Series([set_name(s) if len(s) else None for s in sets], dtype="Int64"),
                    "parts": [part_names(s, num, den) if len(s) else np.empty(0, dtype=np.int64) for s in sets]})
    return run


def tree_links(sets: list[np.ndarray], queries: list[np.ndarray], same: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (or of queries with sets): pairs (set, query)."""
    ranked, vocabulary = rank_sets(sets + ([] if same else queries))
    tree = PrefixTree(ranked[:len(sets)], vocabulary)
    forest, out = Links(len(ranked)), []
    for q in range(0 if same else len(sets), len(ranked)):
        for i in tree.search(ranked[q], num, den):
            if i != q and forest.join(i, q):
                out.append((i, q if same else q - len(sets)))
    return out


def _join_block(size: int, num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        for side, text in zip(group["side"], group["text"]):
            members = shingle_set(text, size)
            sides[side].setdefault(set_name(members), members)
        left, right = (list(s.values()) for s in sides)
        names_left, names_right = (list(s) for s in sides)
        if not right:
            pairs = [(names_left[i], names_left[j]) for i, j in tree_links(left, left, True, num, den)] if len(left) > 1 else []
        else:
            pairs = [(names_left[i], names_right[j]) for i, j in tree_links(left, right, False, num, den)] if left else []
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")
    return run


def _tokens(size: int):
    """The sets of the nodes that are asked for."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                sets = [shingle_set(t, size) for t in part["text"]]
                same = np.array([set_name(s) == node for s, node in zip(sets, part["node"])], dtype=bool)  # an id may repeat
                out = part[["node", "comp", "n"]].assign(tokens=[s.view(np.int64) for s in sets])
                yield out[same]
    return run


def _refine_large(docs: DataFrame, members: DataFrame, size: int, num: int, den: int, block: int) -> DataFrame:
    """``members`` with rough components of over ``block`` shingles taken apart by the prefix filter.

    In the order of (how many sets of the component hold it, hash), two sets that
    link share a shingle among the first n - ceil(num / den * n) + 1 of each. Rare
    shingles come first, so a passage that many sets share hardly ever links them.
    """
    large = members.groupBy("comp").agg(F.sum("n").alias("all_n")).where(F.col("all_n") > block).select(F.col("comp").alias("large"))
    large = stage(large, "large-components")
    big = stage(members.join(large, F.col("comp") == F.col("large")).select("node", F.col("doc_id").alias("placed_id"), "n", "comp"), "large-members")
    small = members.join(large, F.col("comp") == F.col("large"), "left_anti")
    sets = stage(big.join(docs, F.col("placed_id") == F.col("doc_id")).select("node", "comp", "n", "text")
                 .mapInPandas(_tokens(size), "node long, comp long, n long, tokens array<long>"), "large-sets")
    each = sets.select("node", "comp", "n", F.explode("tokens").alias("token"))
    shared = stage(each.groupBy("comp", "token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
                   .select(F.col("comp").alias("c"), F.col("token").alias("t"), "held"), "shared-shingles")
    of_node = Window.partitionBy("node")
    ranked = each.join(shared, (F.col("comp") == F.col("c")) & (F.col("token") == F.col("t"))).select(
        "node", "comp", "n", "token", F.count(F.lit(1)).over(of_node).alias("common"),
        F.row_number().over(of_node.orderBy("held", "token")).alias("rank"))
    alone = F.col("n") - F.col("common")  # shingles that no other set has come first
    length = F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}") + F.lit(1)
    prefix = stage(ranked.where(F.col("rank") <= length - alone).select("node", "comp", "token"), "prefixes")
    firsts = stage(prefix.groupBy("comp", "token").agg(F.min("node").alias("first"), F.max("node").alias("other"))
                   .where("first <> other").select(F.col("comp").alias("c"), F.col("token").alias("t"), "first"), "prefix-shingles")
    roots = components(prefix.join(firsts, (F.col("comp") == F.col("c")) & (F.col("token") == F.col("t")))
                       .where("node <> first").select("node", "first").distinct())
    for table in (sets, shared, prefix, firsts):
        unstage(table)
    member = roots.select(F.col("node").alias("member"), "root")
    apart = big.join(member, F.col("node") == F.col("member")).select("node", F.col("placed_id").alias("doc_id"), "n", F.col("root").alias("comp"))
    refined = stage(small.select("node", "doc_id", "n", "comp").unionByName(apart), "refined-members")
    for table in (large, big, roots):
        unstage(table)
    return refined


def _blocks(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(doc_id, comp, block pair, side): where each node's text goes. Small components are one block."""
    sizes = members.groupBy("comp").agg(F.sum("n").alias("all_n"))
    members = members.join(sizes, "comp")
    small = members.where(F.col("all_n") <= block).select(
        "doc_id", "comp", F.lit(-1).alias("c1"), F.lit(0).alias("b1"), F.lit(-1).alias("c2"), F.lit(0).alias("b2"), F.lit(0).alias("side"))
    big = members.where(F.col("all_n") > block)
    # class of a size: as in size_classes, by the same integer arithmetic
    most = big.agg(F.max("n")).first()[0] or 1
    least = size_classes(num, den, int(most))
    bounds = F.array(*[F.lit(int(x)) for x in least])
    big = big.withColumn("c", F.size(F.filter(bounds, lambda x: x <= F.col("n"))) - 1)
    cut = big.groupBy("comp", "c").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    cut = stage(cut, "blocks")
    big = (big.join(cut, ["comp", "c"])
           .join(cut.select("comp", (F.col("c") + 1).alias("c"), F.col("blocks").alias("down")), ["comp", "c"], "left")
           .join(cut.select("comp", (F.col("c") - 1).alias("c"), F.col("blocks").alias("up")), ["comp", "c"], "left"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def to(c1, b1, c2, b2, side):
        return F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), side.alias("side"))

    def upto(n):  # 0 .. n-1, empty when n is 0 or null
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    c, zero, one = F.col("c"), F.lit(0), F.lit(1)
    pairs = F.concat(
        F.transform(upto(F.col("blocks")), lambda k: to(c, F.least(k, own), c, F.greatest(k, own), F.when(k < own, one).otherwise(zero))),
        F.transform(upto(F.col("up")), lambda k: to(c, own, c + 1, k, zero)),
        F.transform(upto(F.col("down")), lambda k: to(c - 1, k, c, own, one)))
    spread = big.select("doc_id", "comp", F.explode(pairs).alias("p")).select("doc_id", "comp", "p.*")
    return small.unionByName(spread)


def join_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM,
                den: int = DEN, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``df``; component_id is the smallest id reachable by links."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = stage(docs.mapInPandas(_sets(shingle, num, den), f"doc_id {id_type}, n long, node long, parts array<long>"), "sets")
    parts = named.select(F.explode("parts").alias("part"), "node")
    shared = stage(parts.groupBy("part").agg(F.min("node").alias("first"), F.max("node").alias("other"))
                   .where("first <> other").select(F.col("part").alias("shared_part"), "first"), "shared-parts")
    rough = components(parts.join(shared, F.col("part") == F.col("shared_part")).where("node <> first")
                       .select("node", "first").distinct())
    unstage(shared)
    nodes = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = stage(nodes.join(rough.select("node", F.col("root").alias("comp")), "node"), "members")
    unstage(rough)
    refined = _refine_large(docs, members, shingle, num, den, block)
    unstage(members)
    placed = _blocks(refined, num, den, block)
    texts = placed.withColumnRenamed("doc_id", "placed_id").join(docs, F.col("placed_id") == F.col("doc_id"))
    links = texts.groupBy("comp", "c1", "b1", "c2", "b2").applyInPandas(_join_block(shingle, num, den), "a long, b long")
    links = stage(links, "set-links")
    unstage(refined)
    roots = components(links)
    unstage(links)
    grouped = stage(named.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
                    .select("doc_id", "n", F.coalesce("root", "node").alias("root")), "grouped")
    unstage(named)
    unstage(roots)
    least = stage(grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
                  .withColumnRenamed("root", "r"), "least-ids")
    return grouped.join(least, F.col("root") == F.col("r"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_prefix_tree_jaccard(spark, sf_dir):
    """All ``documents`` with the smallest id of their group of near duplicates (3-word shingles, Jaccard 0.9)."""
    return join_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as o
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
e as (select a as u, b as v from l union all select b, a from l),
r(doc_id, reach) as (
  select doc_id, doc_id from w
  union
  select r.doc_id, e.v from r join e on e.u = r.reach)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.reach) as component_id
from r left join n using (doc_id) group by r.doc_id
"""
