"""Conversations as token trees: turns that conversations share from their first one on are emitted once.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. The two control strings
are ids beyond the vocabulary; whatever looks like one inside a text gets a
backslash between ``<`` and ``|``, one more if there are some, so texts come back
as they were and never hold a control id.

A node of the prefix tree is a turn after the same turns, known by its depth and
by a running 128-bit xor of hashes of (content, depth). The first conversation,
in the order of ids, that holds a node owns it; what a conversation owns is the
end of its path, a chain. Depth-first, a chain is followed by the chains that
leave it, deepest first, so sorting chains by the places where their path
changes owner, and summing their tokens, gives every node its place in the
sequence of its tree; positions are tokens above; what a node attends to above
itself is one interval for each chain on its path, as chains lie in one piece.

Scale: order, positions, hashes and places come from range partitions and their
totals (``running``), so neither a conversation nor a first turn that holds a
third of all rows is gathered anywhere. A path that changes owner b times needs
b other conversations of up to b turns, so the lists of a conversation hold at
most the square root of twice all rows, and all of them together at most two
entries a row. Joins meet one row of a node or chain, so AQE can split their
other side. Reading back streams turns in order; a digest of a conversation is
made in one task by nature, with a row in memory at a time.

Null and edge cases: a null text or role counts as empty; a line break in a role
is written as ``<|nl|>``; rows with a null id are one conversation; rows of one
conversation with the same turn number go by role, then by a hash of the
content, and identical rows are turns each; null turn numbers come first; empty
and long texts are kept whole; an empty table has no nodes; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadence.llm.common import stage
from cadence.llm.running import running
from cadence.llm.tokens import encoder, read_ranks

# --- fixed values: the template ---
TURN_BEGIN, TURN_END, ROLE_BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNED_ROLE = "assistant"
# --- end of fixed values ---
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """No ``<|`` is left; ``unescape`` takes exactly the new backslashes away."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ROLE_BREAK)


def unescape_role(role: str) -> str:
    return unescape(role.replace(ROLE_BREAK, "\n"))


class _Vocabulary:
    """Ids and bytes of the tokenizer, with two control ids above the largest one."""
    _open: dict[str, _Vocabulary] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.encode = encoder(path).encode
        self.begin = max(ranks.values()) + 2  # the id between is the end of a text in the tokenizer's file
        self.end = self.begin + 1
        self.bytes = [b""] * (self.begin - 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.newline = self.encode("\n")

    @classmethod
    def of(cls, path: str) -> _Vocabulary:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def turn(self, role: str, text: str) -> tuple[bytes, int, int]:
        """Ids of the turn, and where those of its text begin and end."""
        head = np.asarray([self.begin], dtype="<u2").tobytes() + self.encode(escape_role(role) + "\n")
        body = self.encode(escape(text))
        ids = head + body + np.asarray([self.end], dtype="<u2").tobytes() + self.newline
        return ids, len(head) // 2, (len(head) + len(body)) // 2

    def text(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode()


def _tokenise(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Vocabulary.of(path)
        for batch in batches:
            out = [words.turn(role, text) for role, text in zip(batch["role"], batch["text"])]
            digests = [hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(batch["role"], batch["text"])]
            pair = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            learned = (batch["role"] == LEARNED_ROLE).to_numpy()
            start, end = (np.array([o[k] for o in out], dtype=np.int64) for k in (1, 2))
            yield pd.DataFrame({
                "nth": batch["nth"], "conv_id": batch["conv_id"], "turn": batch["turn"], "role": batch["role"],
                "h1": pair[:, 0], "h2": pair[:, 1], "n_tokens": [len(o[0]) // 2 for o in out],
                "loss_start": np.where(learned, start, 0), "loss_end": np.where(learned, end, 0), "tokens": [o[0] for o in out]})
    return run


@dataclass
class TokenTrees:
    """The formatted conversations.

    ``nodes``: tree, chain, depth, start (place of its first token in the tree's
    depth-first sequence), n_tokens, position (position id of its first token),
    ancestors (intervals of the sequence that its tokens attend to, besides
    those before them in the node), tokens (unsigned 16-bit ids), loss_start and
    loss_end (the tokens of the node under the loss mask).
    ``turns``: conv_id, conv (its number), depth, chain: the node of every turn.
    ``members``: conv_id, conv, tree, intervals of its tokens in the sequence.
    """
    nodes: DataFrame
    turns: DataFrame
    members: DataFrame
    vocabulary: str


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         vocabulary: str | None = None) -> TokenTrees:
    """The token trees of the conversations in ``df``; ``vocabulary`` is the path of a rank file."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = df.select(F.monotonically_increasing_id().alias("nth"), F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    written = stage(rows.mapInPandas(_tokenise(path), (
        f"nth long, conv_id {kind}, turn long, role string, h1 long, h2 long, n_tokens long, loss_start long, loss_end long, tokens binary")), "turn-tokens")

    placed = running(written.drop("tokens"), ["conv_id"], ["turn", "role", "h1", "h2", "nth"],
                     {"depth": ("*", "sum"), "position": ("n_tokens", "sum")}, "turns-in-order", nth="at")
    # the number of a conversation is that of its first row: a sum in which all other rows count nothing
    hashed = placed.withColumns({"own1": F.xxhash64("h1", "h2", "depth"), "own2": F.xxhash64("depth", "h2", "h1", F.lit(1)),
                                 "first": F.when(F.col("depth") == 0, F.col("at")).otherwise(0)})
    linked = running(stage(hashed.drop("turn", "role", "h1", "h2", "at"), "turns-hashed"), ["conv_id"], ["depth"],
                     {"above1": ("own1", "xor"), "above2": ("own2", "xor"), "before": ("first", "sum")}, "turns-linked")
    linked = linked.withColumns({"x1": F.col("above1").bitwiseXOR(F.col("own1")), "x2": F.col("above2").bitwiseXOR(F.col("own2")),
                                 "conv": F.col("before") + F.col("first")})
    linked = linked.select("nth", "conv_id", "conv", "depth", "position", "n_tokens", "x1", "x2")
    owners = linked.groupBy("depth", "x1", "x2").agg(F.min("conv").alias("chain"))
    turns = stage(linked.join(owners, ["depth", "x1", "x2"]).drop("x1", "x2"), "turns-owned")

    hops = stage(turns.groupBy("conv", "chain").agg(
        F.min("depth").alias("from_depth"), F.min("position").alias("from_position"), F.sum("n_tokens").alias("hop_tokens")), "hops")
    paths = hops.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("from_depth", "chain", "hop_tokens", "from_position"))).alias("path"))
    own = F.element_at("path", -1)
    chains = stage(paths.where(own["chain"] == F.col("conv")).select(
        F.col("conv").alias("chain"), F.get("path", F.lit(0))["chain"].alias("tree"), own["hop_tokens"].alias("chain_tokens"),
        own["from_position"].alias("chain_position"),
        F.transform("path", lambda h: F.struct((-h["from_depth"]).alias("a"), h["chain"].alias("b"))).alias("leaves")), "chains")
    starts = running(chains, ["tree"], ["leaves"], {"chain_start": ("chain_tokens", "sum")}, "chains-in-order").select(
        "chain", "tree", "chain_start", "chain_position")

    spans = hops.join(starts, "chain").select("conv", "tree", F.struct(
        "from_depth", F.col("chain_start").alias("start"), (F.col("chain_start") + F.col("hop_tokens")).alias("end"), "chain_position").alias("span"))
    covered = stage(spans.groupBy("conv", "tree").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans")
    interval = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))

    owned = turns.where("conv = chain").select("nth", "chain", "depth", "position").join(covered.withColumnRenamed("conv", "chain"), "chain")
    last = F.element_at("spans", -1)
    start = last["start"] + F.col("position") - last["chain_position"]
    above = F.transform(F.slice("spans", 1, F.size("spans") - 1), interval)
    in_chain = F.when(start > last["start"], F.array(F.struct(last["start"].alias("start"), start.alias("end")))).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>"))
    placed_nodes = owned.select("nth", "tree", "chain", "depth", start.alias("start"), "position", F.concat(above, in_chain).alias("ancestors"))
    nodes = stage(written.select("nth", "n_tokens", "loss_start", "loss_end", "tokens").join(placed_nodes, "nth").select(
        "tree", "chain", "depth", "start", "n_tokens", "position", "ancestors", "tokens", "loss_start", "loss_end"), "nodes")
    firsts = turns.where("depth = 0").select("conv_id", "conv")
    members = firsts.join(covered, "conv").select("conv_id", "conv", "tree", F.transform("spans", interval).alias("intervals"))
    return TokenTrees(nodes, turns.select("conv_id", "conv", "depth", "chain"), members, path)


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(path: str, kind: pa.DataType):
    """Turns in order, from their tokens alone -> one row a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = _Vocabulary.of(path), ["conv_id", *(x.split()[0] for x in READ_BACK.split(", "))]
        current, state = None, None

        def row():
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind if k == 0 else pa.string() if k in (2, 4) else pa.int64())
                                               for k in range(6)], names=names)

        for batch in batches:
            out = []
            for conv_id, conv, ids, loss_start, loss_end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "conv", "tokens", "loss_start", "loss_end"))):
                if state is None or conv != current:
                    if state is not None:
                        out.append(row())
                    current, state = conv, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(ids, dtype="<u2")
                end = int(np.flatnonzero(ids == words.end)[0])
                inside, rest = words.text(ids[1:end]), words.text(ids[end + 1:])
                role, text = inside.split("\n", 1)
                state[1] += 1
                state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                learned = unescape(words.text(ids[loss_start:loss_end]))
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(TURN_BEGIN) + len(inside) + len(TURN_END) + len(rest)
            if out:
                yield table(out)
        if state is not None:
            yield table([row()])
    return run


def read_back(trees: TokenTrees) -> DataFrame:
    """Per conversation, from the tokens: conv_id, turns and the digest of roles and texts, what is under the loss mask, formatted length."""
    turns = trees.turns.join(trees.nodes.select("chain", "depth", "tokens", "loss_start", "loss_end"), ["chain", "depth"])
    ordered = turns.select("conv_id", "conv", "depth", "tokens", "loss_start", "loss_end").repartition("conv").sortWithinPartitions("conv", "depth")
    field = trees.turns.schema["conv_id"].dataType
    return ordered.mapInArrow(_read(trees.vocabulary, to_arrow_type(field)), f"conv_id {field.simpleString()}, {READ_BACK}")


def with_control_strings(df: DataFrame) -> DataFrame:
    """The conversations and one, -1, whose texts look like the template."""
    said = F.lit(f"{TURN_END}{TURN_BEGIN}{LEARNED_ROLE} ok")
    rows = df.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    extra = df.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(LEARNED_ROLE)).alias("role"), said.alias("text"))
    return rows.unionByName(extra)


def op11_chat_prefix_tree(spark, sf_dir):
    """All ``conversations``, and one of control strings, as token trees and read back from them."""
    return read_back(format_conversations(with_control_strings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, n, case when n = 0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from range(2) as t(n)),
formatted as (
  select *, '<|im_start|>' || replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>') || chr(10)
    || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) as formatted from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(formatted))::bigint as formatted_chars
from formatted group by conv_id
"""
