"""Mixture-controlled packing: deficit round-robin over source queues.

Documents of a source form a queue. Output is cut into windows of WINDOW
tokens; in each window every queue is served up to its quantum, its target
share of the window, plus the deficit that earlier windows left it. Documents
may be cut, so a queue is always served to within one token and the deficit it
carries on is the fraction lost to rounding. A queue that runs empty leaves
the round and the others share its part (a new phase). Inside a window the
queues lie one after another, and the windows are cut into sequences.

Because the deficits are plain arithmetic, nothing is replayed: what queue k
has been served after w windows of a phase is a closed form, so each document
finds its place from its position in its queue alone, and deficits carry
across windows, tasks and machines. Positions come from token sums per (queue,
input task). Every source is a queue; shares are a running sum over sources, joined
to the documents by source. Only with explicit targets the driver sees totals, one
for each target given.

Sequences have exactly SEQUENCE tokens but for the last one, so nearly nothing
is padded.

Null and edge cases: a null text counts as empty and still gives its end id; a
null source, and with targets one that has none, goes to the queue ``OTHER``, which a
source of that name shares; repeated rows are packed each;
an empty table gives an empty result; very long texts are cut at sequence ends
like others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import documents, stage
from cadence.llm.tokens import encoder

SEQUENCE = 1024
#: Tokens in which the target proportions hold.
WINDOW = 64 * SEQUENCE
OTHER = "*"
#: Id at the end of a document.
END = 0

PIECE = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
         "offset long, queue string, window_id long")


def _tokenise(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        served: dict[str, int] = {}
        end = np.asarray([END], dtype="<u2").tobytes()
        for batch in batches:
            ids, before, n = [], [], []
            for queue, text in zip(batch["queue"], batch["text"]):
                data = (enc.encode_added(text) if text else b"") + end
                at = served.get(queue, 0)
                ids.append(data)
                before.append(at)
                n.append(len(data) // 2)
                served[queue] = at + len(data) // 2
            yield pd.DataFrame({"doc_id": batch["doc_id"], "queue": batch["queue"], "task": task,
                                "before": before, "n": n, "ids": ids})
    return run


def schedule(totals: dict[str, int], targets: dict[str, float] | None = None) -> list[dict]:
    """Phases of the round-robin: tokens that each queue gives while the same queues are still filled.

    Without targets the shares are those of the tokens: one phase in which all
    queues run empty together.
    """
    left = {q: n for q, n in sorted(totals.items()) if n > 0}
    if not targets:
        targets = {q: float(n) for q, n in left.items()}
    weight = {q: max(targets.get(q, 0.0), 1e-9) for q in left}
    used = dict.fromkeys(left, 0)
    phases, at = [], 0
    while left:
        first = min(left, key=lambda q: (left[q] / weight[q], q))
        rounds = left[first] / weight[first]
        takes = {q: left[q] if q == first else min(left[q], round(rounds * weight[q])) for q in left}
        length = sum(takes.values())
        queues, low = {}, 0
        for q, take in takes.items():
            queues[q] = (used[q], low, low + take)  # tokens given before, cumulative share below and up to it
            low += take
            used[q] += take
            left[q] -= take
        phases.append({"at": at, "length": length, "queues": queues})
        at += length
        left = {q: n for q, n in left.items() if n > 0}
    return phases


def place(phases: list[dict], queue: str, x: int, n: int, window: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (start, length, place in the output, window) of tokens x .. x+n-1 of a queue."""
    first_window = 0
    done = 0
    for phase in phases:
        length = phase["length"]
        windows = -(-length // window)
        if queue in phase["queues"]:
            given, low, high = phase["queues"][queue]
            share = high - low

            def served(w, cum):
                return min(w * window, length) * cum // length

            while done < n and given <= x + done < given + share:
                u = x + done - given
                w = u * length // (share * window)
                while served(w, high) - served(w, low) > u:
                    w -= 1
                while served(w + 1, high) - served(w + 1, low) <= u:
                    w += 1
                begin = served(w, high) - served(w, low)
                until = served(w + 1, high) - served(w + 1, low)
                y = phase["at"] + w * window + (served(w + 1, low) - served(w, low)) + (u - begin)
                take = min(n - done, until - u, sequence - y % sequence)
                yield done, take, y, first_window + w
                done += take
        first_window += windows
        if done >= n:
            return


def _cut(phases: list[dict] | None, window: int, sequence: int):
    """Pieces of the documents; without ``phases`` there is one phase, and each row has its share of it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            shares = zip(batch["low"], batch["high"], batch["total"])
            for doc_id, queue, x, n, ids, (low, high, total) in zip(batch["doc_id"], batch["queue"], batch["x"], batch["n"], batch["ids"], shares):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                plan = [{"at": 0, "length": int(total), "queues": {queue: (0, int(low), int(high))}}] if phases is None else phases
                for start, length, y, w in place(plan, queue, int(x), int(n), window, sequence):
                    rows.append((doc_id, start, length, zlib.crc32(wide[4 * start:4 * (start + length)]), n,
                                 y // sequence, y % sequence, queue, w))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                              "offset", "queue", "window_id"])
    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         targets: dict[str, float] | None = None, vocabulary: str | None = None,
         sequence: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, window_id.

    ``targets`` are the wanted proportions by source (default: those of the
    tokens); ``vocabulary`` is the path of a rank file.
    """
    if window % sequence:
        raise ValueError("a window is a whole number of sequences")
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                     F.col(source_col).cast("string").alias("source"))
    queue = F.coalesce("source", F.lit(OTHER))
    if targets:
        named = df.sparkSession.createDataFrame([(q,) for q in sorted(targets)], "target string")
        docs = docs.join(F.broadcast(named), F.col("source") == F.col("target"), "left")
        queue = F.coalesce("target", F.lit(OTHER))
    docs = docs.withColumn("queue", queue)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = stage(docs.select("doc_id", "queue", "text").mapInPandas(
        _tokenise(path), f"doc_id {id_type}, queue string, task int, before long, n long, ids binary"), "token-ids")
    cells = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n_cell"))
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    cells = stage(cells.select("queue", "task", "n_cell", F.coalesce(F.sum("n_cell").over(earlier), F.lit(0)).alias("base")), "cells")
    totals = cells.groupBy("queue").agg(F.sum("n_cell").alias("n"))
    phases = schedule({r.queue: int(r.n) for r in totals.collect()}, targets) if targets else None
    upto = Window.orderBy("queue").rowsBetween(Window.unboundedPreceding, 0)  # one row a source
    every = Window.orderBy("queue").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = totals.select(F.col("queue").alias("of"), (F.sum("n").over(upto) - F.col("n")).alias("low"),
                           F.sum("n").over(upto).alias("high"), F.sum("n").over(every).alias("total"))
    places = stage(cells.join(shares, F.col("queue") == F.col("of")).select("queue", "task", "base", "low", "high", "total"), "shares")
    placed = tokens.join(places, ["queue", "task"])
    return placed.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("x"), "n", "ids", "low", "high", "total").mapInPandas(
        _cut(phases, window, sequence), PIECE.format(id=id_type))


def op10_mixture_packing(spark, sf_dir):
    """All ``documents`` in sequences of 1024 tokens, every window mixed like the corpus."""
    return pack(documents(spark, sf_dir))
