"""Periodic runs of words in texts, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words in which words q places apart are equal
for a smallest period q, that holds at least max(MIN_WORDS, 2 q) words and that no
neighbour extends. A run that long holds each of its words twice, so a word that
occurs once in a segment belongs to no run in it and splits it. Splitting goes on
until no segment has such a word; segments shorter than MIN_WORDS are dropped.
What is left is scanned lag by lag: two neighbours among the multiples of lag q
lie in every run of period q, so only pairs of equal words at (j q, (j+1) q) are
extended, by names of blocks of 1, 2, 4 ... words. Names are exact, not hashes.

Scale: texts are worked on where they are read, nothing is shuffled. A slice of
texts is split as a whole in arrays; the work is that of sorting its words, and
S log S pairs at most for a segment of S words. Memory is bounded by the slice,
or by one text if that is longer than a slice.

Null and edge cases: null and empty texts have no words and no runs; long texts
are taken whole; rows are independent of each other, so repeated ids and rows
make no difference, and a null id comes back null; an empty table gives none;
other columns are ignored, whatever their names; of runs of equal length the
first, then that of the smallest period is the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import documents
from cadence.llm.merkle import CRC32_SQL

#: Words in a run at least.
MIN_WORDS = 12
#: Bytes of texts that are worked on together.
SLICE_BYTES = 2 << 20
#: Rounds of splitting over whole arrays while each takes away 1/SHRINK of the words; then segment by segment.
SHRINK = 32
#: The words of a text.
WORDS = r"[^\x20\x09-\x0D]+"


def _neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the same code before and after each place (-1 and len if none)."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _split_one(before: list[int], after: list[int], start: int, end: int, least: int) -> list[tuple[int, int]]:
    """Stable segments of [start, end). Looked for from both ends, a splitting word costs the smaller half: n log n in all."""
    found, todo = [], [(start, end)]
    while todo:
        s, e = todo.pop()
        if e - s < least:
            continue
        for k in range((e - s + 1) // 2):
            cut = s + k if before[s + k] < s and after[s + k] >= e else e - 1 - k
            if before[cut] < s and after[cut] >= e:
                todo += [(s, cut), (cut + 1, e)]
                break
        else:
            found.append((s, e))
    return found


def split_rare(codes: np.ndarray, starts: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Segments of at least ``least`` words in which no word occurs once; ``starts`` begin the texts, codes differ between texts."""
    before, after = _neighbours(codes)
    lows, highs, at = starts, np.append(starts[1:], len(codes)), np.arange(len(codes))
    while True:
        sizes = highs - lows
        keep = sizes >= least
        at, lows, highs, sizes = at[np.repeat(keep, sizes)], lows[keep], highs[keep], sizes[keep]
        low, high = np.repeat(lows, sizes), np.repeat(highs, sizes)
        rare = (before[at] < low) & (after[at] >= high)
        if not rare.any():
            return list(zip(lows.tolist(), highs.tolist()))
        if rare.sum() * SHRINK < len(at):
            b, a = before.tolist(), after.tolist()
            return [x for s, e in zip(lows.tolist(), highs.tolist()) for x in sorted(_split_one(b, a, s, e, least))]
        stays = ~rare  # segments now begin and end beside the rare places
        begins = stays & ((at == low) | np.concatenate([[True], rare[:-1]]))
        ends = stays & ((at == high - 1) | np.concatenate([rare[1:], [True]]))
        at, lows, highs = at[stays], at[begins], at[ends] + 1


def _names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] is equal for equal blocks of 2^k codes from i; blocks beyond the end are short."""
    names = [codes]
    while 2 << (len(names) - 1) <= longest:
        half, last = 1 << (len(names) - 1), names[-1]
        second = np.concatenate([last[half:] + 1, np.zeros(min(half, len(last)), dtype=np.int64)])
        _, name = np.unique(last * (int(last.max()) + 2) + second, return_inverse=True)
        names.append(name.astype(np.int64))
    return names


def _extend(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from a and b on (or before them) are equal."""
    n, far = len(names[0]), np.zeros(len(a), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        block = 1 << k
        i, j = (a + far, b + far) if forward else (a - far - block, b - far - block)
        fits = (j + block <= n) if forward else (i >= 0)
        i, j = np.where(fits, i, 0), np.where(fits, j, 0)
        far += np.where(fits & (names[k][i] == names[k][j]), block, 0)
    return far


def scan_lags(codes: np.ndarray, segments: list[tuple[int, int]], least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; places are those in ``codes``."""
    none = np.zeros(0, dtype=np.int64)
    if not segments:
        return none, none, none
    lows, highs = (np.array(x, dtype=np.int64) for x in zip(*segments))
    sizes = highs - lows
    # the segments side by side, a code of its own after each, so that nothing extends beyond
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    place = np.repeat(lows - offsets, sizes + 1) + np.arange(int((sizes + 1).sum()))
    stops = offsets + sizes
    inside = np.ones(len(place), dtype=bool)
    inside[stops] = False
    _, dense = np.unique(codes[place[inside]], return_inverse=True)
    words = np.empty(len(place), dtype=np.int64)
    words[inside] = dense
    words[stops] = dense.max() + 1 + np.arange(len(stops))
    # blocks of 2^k codes may hold a stop, which is equal to nothing else, so equal blocks lie in segments
    longest, names = int(sizes.max()), None

    lags = sizes // 2
    segment, found = np.repeat(np.arange(len(sizes)), lags), []
    lag = np.arange(int(lags.sum())) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    pairs = (sizes[segment] - 1) // lag  # multiples j q with (j+1) q inside
    chunk = 1 << 20
    upto = np.cumsum(pairs)
    first = 0
    while first < len(lag):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + chunk, side="right")))
        p = pairs[first:last]
        q = np.repeat(lag[first:last], p)
        j = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
        a = np.repeat(offsets[segment[first:last]], p) + j * q
        equal = words[a] == words[a + q]
        a, q = a[equal], q[equal]
        if len(a):
            names = names or _names(words, longest)
            start = a - _extend(names, a, a + q, False)
            length = a + q + _extend(names, a, a + q, True) - start
            holds = length >= np.maximum(least, 2 * q)
            found.append(np.stack([start[holds], length[holds], q[holds]]))
        first = last
    if not found:
        return none, none, none
    start, length, period = np.concatenate(found, axis=1)
    # the same stretch under a multiple of its smallest period, or met at several pairs: the smallest period counts
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return place[start[order]], length[order], period[order]


def find_runs(texts: list[bytes | None], least: int = MIN_WORDS) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: its words, and start, length and period of its runs by start, then period."""
    words = [t.split() if t else [] for t in texts]
    codes, starts, total = [], [], 0
    for w in words:
        names: dict[bytes, int] = {}
        starts.append(total)
        codes += [names.setdefault(x, len(names) + total) for x in w]
        total += len(w)
    all_codes, all_starts = np.array(codes, dtype=np.int64), np.array(starts, dtype=np.int64)
    del codes
    start, length, period = scan_lags(all_codes, split_rare(all_codes, all_starts, least), least)
    bounds = np.searchsorted(start, np.append(all_starts, total))
    for k, w in enumerate(words):
        own = slice(bounds[k], bounds[k + 1])
        yield w, start[own] - starts[k], length[own], period[own]


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that are in no run beyond its first period, joined by one space."""
    if not len(start):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0))


RESULT = "n_words long, n_runs long, start long, length long, period long, runs string, collapsed string"


def _work(least: int):
    names = ["id", *(x.split()[0] for x in RESULT.split(", "))]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for words, start, length, period in find_runs(batch.column("text").to_pylist(), least):
            best = (None, None, None)
            if len(start):
                k = np.lexsort((period, start, -length))[0]
                best = int(start[k]), int(length[k]), int(period[k])
            runs = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()))
            rows.append((len(words), len(start), *best, runs, collapse(words, start, length, period).decode()))
        columns = [batch.column("id"), *(pa.array(c, pa.string() if k > 4 else pa.int64()) for k, c in enumerate(zip(*rows)))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([0 if not x.is_valid else len(x.as_buffer()) for x in batch.column("text")], dtype=np.int64)
            upto, first = np.cumsum(sizes), 0
            while first < len(sizes):
                done = int(upto[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(upto, done + SLICE_BYTES, side="right")))
                yield one(batch.slice(first, last - first))
                first = last
    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: Column | None = None, least: int = MIN_WORDS) -> DataFrame:
    """Per row: the id, n_words, n_runs, the longest run (start, length, period), all ``runs`` as lines, the ``collapsed`` text."""
    rows = df.select(F.col(id_col).alias("id"), (F.col("text") if text is None else text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_work(least), f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def planted(id_col: Column, text: Column) -> Column:
    """The text; where the id's crc32 ends in 0, its words from one place on repeat a few of them."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    # one evaluation of the words: they are the argument of an outer transform of one element
    again = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeat(w), " ")).otherwise(""))
    return F.when(h % 10 == 0, F.get(again, F.lit(0))).otherwise(text)


def op13_periodic_runs(spark, sf_dir):
    """Runs of all ``documents``, a tenth of them with planted repeats, and what is left without them."""
    found = periodic_runs(documents(spark, sf_dir), text=planted(F.col("doc_id"), F.col("text")))
    return found.select("doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
                        F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE_SQL = f"""
with texts as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    case when doc_id is null then 1 else {CRC32_SQL.format("doc_id::varchar")} end as h from documents),
places as (
  select *, len(w) as n, case when len(w) > 0 then (h // 10) % len(w) else 0 end as a from texts),
planted as (
  select rid, doc_id, case when h % 10 = 0 and n > 0
    then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] end)
    else w end as w from places),
words as (
  select rid, unnest(w) as word, unnest(range(0, len(w))) as i, len(w) as n from planted),
pairs as (
  select x.rid, x.i, y.i - x.i as q from words x join words y on y.rid = x.rid and y.word = x.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
stretches as (
  select rid, q, min(i) as start, count(*) + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) as island from pairs) group by rid, q, island),
runs as (
  select rid, start, length, min(q) as period from stretches where length >= greatest(12, 2 * q) group by rid, start, length),
lines as (
  select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
    first({{'start': start, 'length': length, 'period': period}} order by length desc, start, period) as best from runs group by rid),
gone as (
  select distinct rid, unnest(range(start + period, start + length)) as i from runs),
collapsed as (
  select rid, string_agg(word, ' ' order by i) as collapsed from words anti join gone using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
  (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
  sha256(coalesce(collapsed, '')) as collapsed_sha256
from planted left join lines using (rid) left join collapsed using (rid)
"""
