"""Byte-level BPE encoding and decoding of texts, batch by batch in the tasks.

A match of the pattern starts as its bytes; the leftmost pair of neighbours of
the lowest rank becomes one piece, and with it the two pairs around it change,
until no pair has a rank. Short matches look ranks up by the ids of two pieces. In a match of over SHORT bytes, such as a block of
base64, pairs wait in a heap, so it costs n log n steps.

Words between single spaces begin and end with a match, so each is encoded once
by a Python worker that keeps it, and so are the matches in other stretches
(MAX_WORDS of either at most, then it starts afresh). The bound shifts work, not results.

Decoding concatenates the bytes of the ids' pieces.

Null and edge cases: a null text counts as empty and has no ids (the digest of
nothing); white space is that of Unicode; texts are encoded whole; repeated rows
are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import documents
from cadence.llm.tokens import read_ranks, space_cut

#: Words that a worker keeps with their ids, at most.
MAX_WORDS = 200_000
#: Longer words are not kept.
MAX_WORD_CHARS = 64
#: Bytes of a match up to which the lowest pair is sought in a list.
SHORT = 48
#: Bits of an id in a pair of two.
BITS = 20
#: Texts that are handed on at once.
TEXTS = 256
#: The white space of Unicode, which the classes of Python's patterns exceed by some control characters.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

ENCODED = "ids array<int>, ids_bytes binary, decoded binary"


class Pairs(dict):
    """Rank of two pieces, by the id of the first shifted by BITS plus that of the second, where they make a piece."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.of_byte = [ranks.get(bytes([b])) for b in range(256)]
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                first, second = ranks.get(piece[:i]), ranks.get(piece[i:])
                if first is not None and second is not None:
                    self[first << BITS | second] = rank


def fold(word: bytes, ranks: dict[bytes, int], pairs: Pairs | None = None) -> list[int]:
    """Ids of one match of the pattern by ranked merges."""
    if word in ranks:  # a word that is a piece needs no merge
        return [ranks[word]]
    n = len(word)
    if n <= SHORT and pairs is not None:
        return _fold_short(word, pairs)
    end, begin = list(range(1, n + 1)), list(range(-1, n))  # end of the piece from i; start of the piece before i (-1: none)
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapify(heap)
    alive = [True] * n

    def push(i: int) -> None:
        if end[i] < n and (rank := ranks.get(word[i:end[end[i]]])) is not None:
            heappush(heap, (rank, i, end[end[i]]))

    while heap:
        _, i, to = heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:  # its pieces have changed
            continue
        alive[end[i]] = False
        end[i] = to
        if to < n:
            begin[to] = i
        push(i)
        if begin[i] >= 0:
            push(begin[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def _fold_short(word: bytes, pairs: Pairs) -> list[int]:
    get, none = pairs.get, 1 << 2 * BITS
    ids = [pairs.of_byte[b] for b in word]
    low = [get(a << BITS | b, none) for a, b in zip(ids, ids[1:])]
    while low:
        least = min(low)
        if least == none:
            break
        k = low.index(least)
        ids[k] = least  # the id of a piece is its rank
        del ids[k + 1], low[k]
        if k < len(low):
            low[k] = get(least << BITS | ids[k + 1], none)
        if k:
            low[k - 1] = get(ids[k - 1] << BITS | least, none)
    return ids


class Words:
    """Ids of words (little-endian unsigned 32-bit), kept while there is room."""

    def __init__(self, path: str, most: int):
        self.ranks, self.most = read_ranks(path), most
        if max(self.ranks.values()) >= 1 << BITS:
            raise ValueError(f"ids do not fit {BITS} bits")
        self.pairs, self.pieces = Pairs(self.ranks), {v: k for k, v in self.ranks.items()}
        self.kept: dict[str, bytes] = {}  # of words, with the space before them
        self.folded: dict[str, bytes] = {}  # of matches
        self.matches = regex.compile(PATTERN)

    def keep(self, kept: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) <= MAX_WORD_CHARS:
            if len(kept) >= self.most:
                kept.clear()
            kept[key] = ids
        return ids

    def match(self, match: str) -> bytes:
        ids = fold(match.encode(), self.ranks, self.pairs)
        return self.keep(self.folded, match, pack(f"<{len(ids)}I", *ids))

    def ids(self, text: str) -> bytes:
        get, match, found = self.folded.get, self.match, self.matches.findall(text)
        if len(found) == 1:
            return get(found[0]) or match(found[0])
        return b"".join([get(m) or match(m) for m in found])

    def miss(self, word: str) -> bytes:
        return self.keep(self.kept, word, self.ids(" " + word))

    def encode(self, text: str) -> bytes:
        first, *words = space_cut(text)
        get, miss = self.kept.get, self.miss
        return b"".join([self.ids(first), *[get(w) or miss(w) for w in words]])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


#: Those of this Python worker.
_WORDS: dict[tuple[str, int], Words] = {}


def _encoded(path: str, most: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if (path, most) not in _WORDS:
            _WORDS[path, most] = Words(path, most)
        words = _WORDS[path, most]
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                wire = [words.encode(t or "") for t in batch.iloc[at:at + TEXTS]]
                ids = [np.frombuffer(w, dtype="<i4") for w in wire]
                yield pd.DataFrame({"ids": ids, "ids_bytes": wire, "decoded": [words.decode(i) for i in ids]})
    return run


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, ids (array<int>), ids_bytes and decoded (binary): one row per row of ``df``."""
    encoded = F.pandas_udf(_encoded(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), max_words), ENCODED)
    return df.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col)).alias("encoded")).select("doc_id", "encoded.*")


def op5_byte_bpe(spark, sf_dir):
    """All ``documents`` encoded and decoded again, as digests."""
    out = encode_decode(documents(spark, sf_dir))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
