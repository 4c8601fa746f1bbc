"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes when it lies in a string of LENGTH bytes that also starts earlier: in
a document with a smaller id, or earlier in the same one. Strings are judged on
the input.

0. A document that equals an earlier one as a whole goes at once, and takes no
   further part: all its strings start earlier.
1. Sampling: equal strings of LENGTH bytes share a sampled position at the same
   offset (suffix_buckets.anchors), one in about 35 bytes.
2. Initial buckets: the GRAM bytes at a sampled position. A bucket of one holds
   no repeat and is finished; counts are combined map-side and only the buckets
   of two or more go on (job 1 and 2).
3. Refinement: positions meet by bucket with the text of the strings that are
   sampled there, up to LENGTH bytes after and LENGTH - GRAM before them. The suffixes of a bucket are sorted by the bucket
   identifiers of later offsets, refined names serving again for spans of twice
   the length; prefixes likewise to the left. Every string through the position
   is then a pair of names, and its earliest occurrence is known (job 3). Names
   are made from the bytes themselves, so hash collisions do not matter.
4. A bucket with over SPLIT positions is dealt to several tasks by position;
   strings that are first in their share meet again by a 128-bit hash, each at
   most once a share (job 4). Nothing is capped.
5. Runs are collected per document and cut out of the text (job 5).

Null and edge cases: a null text counts as empty; texts under LENGTH bytes stay
whole; ids are integers, a null id comes after all others; rows that repeat an
id are told apart by 32 bits of a hash of the content and ordered by it; identical rows are one
document and get the same result each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage, unstage
from cadence.llm.suffix_buckets import anchors, names_at, refine

LENGTH = 100
GRAM = 32
#: Positions of one bucket that one task refines at most.
SPLIT = 10_000
#: Positions that a task takes at a time, about.
SHARE = 16_000

#: A place is (version of the id) << _BITS | byte; no string of the JVM is longer than that.
_BITS = 31
_POSITION = (1 << _BITS) - 1
#: Rows whose contexts are laid out at a time.
_ROWS = 2_048


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _sample(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                docs, pos, grams, before, after = [], [], [], [], []
                for doc, version, text in zip(part["doc"], part["version"], part["text"]):
                    p, h, first, last = anchors(np.frombuffer(_bytes(text), dtype=np.uint8), length, gram)
                    docs.append(np.full(len(p), doc, dtype=np.int64))
                    pos.append(p | (int(version) << _BITS))
                    grams.append(h)
                    before.append(p - first)
                    after.append(last + length - p)
                yield pd.DataFrame({"doc": np.concatenate(docs), "pos": np.concatenate(pos), "gram": np.concatenate(grams).view(np.int64),
                                    "before": np.concatenate(before).astype(np.int16), "after": np.concatenate(after).astype(np.int16)})
    return run


def _contexts(length: int, gram: int):
    """Rows with the text of the strings at each position that has to be refined."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text, places in zip(batch["doc"], batch["text"], batch["places"]):
                data = _bytes(text)
                at = [p["pos"] & _POSITION for p in places]
                yield pd.DataFrame({
                    "gram": [p["gram"] for p in places], "shares": [p["shares"] for p in places], "doc": doc,
                    "pos": [p["pos"] for p in places], "lead": [p["before"] for p in places],
                    "context": [data[a - p["before"]:a + p["after"]] for a, p in zip(at, places)]})
    return run


def _merge_frames(rows: Iterator[pd.DataFrame], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of a few rows joined into larger ones."""
    held, n = [], 0
    for frame in rows:
        held.append(frame)
        n += len(frame)
        if n >= least:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _side(data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, width: int) -> np.ndarray:
    """The ``size`` bytes from ``begin`` on in steps of ``step``, as rows of ``width`` bytes filled up with zeros."""
    out = np.zeros((len(begin), width), dtype=np.uint8)
    reach = np.arange(width)
    for at in range(0, len(begin), _ROWS):  # the matrix of places is eight times the matrix of bytes
        part = slice(at, at + _ROWS)
        places = np.clip(begin[part, None] + step * reach, 0, len(data) - 1)
        np.copyto(out[part], data[places], where=reach < size[part, None])
    return out


def repeats(group: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """Refine the buckets of ``group``: removed spans, and first strings of split buckets.

    Rows are sampled positions with gram, shares, share, doc, pos, lead, context.
    """
    left = length - gram
    group = group.sort_values(["doc", "pos"], kind="stable", ignore_index=True)
    group = group.drop_duplicates(["doc", "pos", "gram"], ignore_index=True)  # identical rows are one document
    rows = len(group)
    lead = group["lead"].to_numpy(np.int64)
    sizes = np.fromiter(map(len, group["context"]), dtype=np.int64, count=rows)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.concatenate([np.frombuffer(b"".join(group["context"]), dtype=np.uint8), np.zeros(1, dtype=np.uint8)])
    tail = sizes - lead
    after = _side(data, start + lead, tail, 1, length)
    before = _side(data, start + lead - 1, lead, -1, left)
    _, bucket = np.unique(np.stack([group["gram"].to_numpy(np.int64), group["share"].to_numpy(np.int64)]), axis=1, return_inverse=True)
    bucket = bucket.ravel()
    order_r, rank_r, common_r = refine(bucket, after)
    order_l, rank_l, common_l = refine(bucket, before)

    most, least = np.minimum(left, lead), np.maximum(0, length - tail)  # offsets of strings that fit the text
    # rows with the same whole context: all strings of a later one repeat those of the first
    key = np.stack([rank_r, rank_l, lead, tail])
    _, first, same = np.unique(key, axis=1, return_index=True, return_inverse=True)
    is_first = np.zeros(rows, dtype=bool)
    is_first[first] = True
    low, high = np.where(is_first, 1 << 30, least), np.where(is_first, -1, most)
    classes = np.bincount(bucket[is_first], minlength=bucket.max() + 1 if rows else 0)
    split = group["shares"].to_numpy(np.int64) > 1
    at = np.flatnonzero(is_first & ((classes[bucket] > 1) | split))
    fresh: list[tuple[int, int, int, int]] = []
    pos = group["pos"].to_numpy(np.int64)
    doc = group["doc"].to_numpy(np.int64)
    base = rows + 1
    for o in range(left + 1):
        fits = at[(least[at] <= o) & (o <= most[at])]
        if not len(fits):
            continue
        pair = names_at(order_l, common_l, o)[fits] * base + names_at(order_r, common_r, length - o)[fits]
        _, head = np.unique(pair, return_index=True)  # rows are in order of occurrence, so the first is the earliest
        repeat = np.ones(len(fits), dtype=bool)
        repeat[head] = False
        hit = fits[repeat]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
        for i in fits[~repeat & split[fits]].tolist():
            s = int(start[i] + lead[i] - o)
            h = xxhash.xxh3_128_intdigest(data[s:s + length].tobytes())
            fresh.append((int(doc[i]), int(pos[i]) - o, h & ((1 << 63) - 1), h >> 65))
    gone = np.flatnonzero(high >= low)
    spans = pd.DataFrame({"doc": doc[gone], "from": pos[gone] - high[gone], "to": pos[gone] - low[gone] + length, "h1": 0, "h2": 0})
    new = pd.DataFrame(fresh, columns=["doc", "from", "h1", "h2"], dtype="int64")
    new.insert(2, "to", -1)
    return pd.concat([spans, new], ignore_index=True).astype("int64")


def _refine(length: int, gram: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: repeats(group, length, gram)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"]):
            data = _bytes(text)
            runs: list[list[int]] = []
            for a, b in sorted((s["from"] & _POSITION, s["to"] & _POSITION) for s in (spans if spans is not None else ())):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(data)]
            rest = b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
            out.append((len(data), len(data) - len(rest), len(runs), rest, [tuple(r) for r in runs]))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [x[0] for x in out], "n_removed": [x[1] for x in out],
                            "n_spans": [x[2] for x in out], "kept": [x[3] for x in out],
                            "spans": [[{"from": a, "to": b} for a, b in x[4]] for x in out]})


def _later_copies(names: DataFrame) -> DataFrame:
    """(copy, copy_version, bytes) of texts that equal the whole text of an earlier document.

    All their strings start earlier there, and whatever they would be the first
    to hold, that document holds too; so a group of copies, however large, goes
    on as one document.
    """
    order = F.struct("doc", "version")
    first = stage(names.groupBy("name").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
                  .select(F.col("name").alias("same"), "first"), "first-copies")
    return (names.join(first, F.col("name") == F.col("same")).where(order != F.col("first"))
            .select(F.col("doc").alias("copy"), F.col("version").alias("copy_version"), F.col("bytes").cast("long").alias("bytes")).distinct())


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left), spans (removed runs): one row per row of ``df``."""
    if not 8 <= gram < length:
        raise ValueError("a gram is shorter than the strings looked for")
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
                     F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # the version of a document is needed only where ids repeat, and costs shuffle otherwise
    again = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    version = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)) if again else F.lit(0).cast("long")
    docs = docs.withColumn("version", version)

    whole_text = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    names = stage(docs.select("doc", "version", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), whole_text.alias("name")), "text-names")
    copies = stage(_later_copies(names.where(F.col("bytes") >= length)), "copies")

    placed = stage(docs.select("doc", "version", "text").mapInPandas(
        _sample(length, gram), "doc long, pos long, gram long, before short, after short"), "positions")

    def shared_grams(rows: DataFrame) -> DataFrame:
        return stage(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .select(F.col("gram").alias("shared"), "n"), "shared-grams")

    repeated = placed.join(shared_grams(placed).select("shared"), F.col("gram") == F.col("shared"), "left_semi")
    no_copies = stage(repeated.join(copies, (F.col("doc") == F.col("copy")) & (F.shiftright("pos", _BITS) == F.col("copy_version")),
                                    "left_anti"), "positions-of-firsts")
    unstage(placed)
    shared = shared_grams(no_copies)
    total = shared.agg(F.sum("n")).first()[0] or 0
    open_rows = stage(no_copies.join(shared, F.col("gram") == F.col("shared")).select(
        "doc", "pos", "gram", "before", "after", F.ceil(F.col("n") / F.lit(split)).cast("int").alias("shares")), "open-positions")
    unstage(no_copies)
    per_doc = (open_rows.groupBy(F.col("doc").alias("at"), F.shiftright("pos", _BITS).alias("v"))
               .agg(F.collect_set(F.struct("pos", "gram", "before", "after", "shares")).alias("places")))
    texts = per_doc.join(docs, (F.col("at") == F.col("doc")) & (F.col("v") == F.col("version"))).dropDuplicates(["at", "v"]) if again \
        else per_doc.join(docs, F.col("at") == F.col("doc"))
    around = texts.select("doc", "text", "places").mapInPandas(
        lambda batches: _merge_frames(_contexts(length, gram)(batches)),
        "gram long, shares int, doc long, pos long, lead int, context binary")
    around = around.withColumn("share", F.when(F.col("shares") > 1, F.pmod(F.xxhash64("doc", "pos"), F.col("shares"))).otherwise(F.lit(0)).cast("int"))
    tasks = int(max(1, -(-total // SHARE)))
    found = stage(around.groupBy(F.pmod(F.xxhash64("gram", "share"), F.lit(tasks)).alias("task")).applyInPandas(
        _refine(length, gram), "doc long, `from` long, `to` long, h1 long, h2 long"), "found-spans")
    unstage(open_rows)
    spans = found.where("`to` >= 0").select("doc", "from", "to")
    # strings that are first in their share of a split bucket: one row a share at most
    first = found.where("`to` < 0").groupBy("h1", "h2").agg(
        F.min(F.struct("doc", "from")).alias("first"), F.collect_list(F.struct("doc", "from")).alias("all"))
    later = (first.select("first", F.explode("all").alias("x")).where("x <> first")
             .select("x.doc", "x.from", (F.col("x.from") + F.lit(length)).alias("to")))
    copied = copies.select(F.col("copy").alias("doc"), F.shiftleft("copy_version", _BITS).alias("from"),
                           (F.shiftleft("copy_version", _BITS) + F.col("bytes")).alias("to"))
    per_doc = (spans.unionByName(later).unionByName(copied).groupBy(F.col("doc").alias("at"), F.shiftright("from", _BITS).alias("v"))
               .agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    whole = docs.join(per_doc, (F.col("at") == F.col("doc")) & (F.col("v") == F.col("version")), "left")
    return whole.select("doc_id", "text", "spans").mapInPandas(
        _cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<`from`:long,`to`:long>>")


def op2_bucket_pointer_dedup(spark, sf_dir):
    """All ``documents`` without strings of 100 bytes that start earlier, as digests."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
