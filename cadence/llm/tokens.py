"""Ids of the public byte-level BPE vocabulary inside tasks, with a bounded cache of words."""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import public_tokenizers
import tiktoken

#: Words that a Python worker keeps with their ids; beyond it words are encoded again, with the same result.
CACHE_WORDS = 150_000
#: Longer words are not kept.
CACHE_CHARS = 48

_DOUBLE_SPACE = re.compile(r"\s\s")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, "WordEncoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_added(path: str) -> dict[str, int]:
    """Added tokens of the tokenizer file beside a rank file, which stand for themselves wherever a text holds them."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def space_cut(text: str) -> list[str]:
    """``text`` cut at single spaces between two characters that are not white space, where the pattern begins a new match."""
    return _INNER_SPACE.split(text) if _DOUBLE_SPACE.search(text) else text.split(" ")


class WordEncoder:
    """Text to ids as little-endian unsigned 16-bit integers.

    A single space between two characters that are not white space always
    begins a new match of the pattern, so a text may be cut there and the
    pieces encoded one by one; frequent pieces come from a cache.
    """

    def __init__(self, path: str):
        ranks, self._added = read_ranks(path), read_added(path)
        if max([*ranks.values(), *self._added.values()]) >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        self._cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._bpe.encode_ordinary(text), dtype="<u2").tobytes()

    def _miss(self, word: str) -> bytes:
        ids = self._ids(" " + word)
        if len(word) <= CACHE_CHARS:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = space_cut(text)
        get, miss = self._cache.get, self._miss
        out = [self._ids(words[0])] if words[0] else []
        out += [get(w) or miss(w) for w in words[1:]]
        return b"".join(out)

    def encode_added(self, text: str) -> bytes:
        """As ``encode``, with the ids of added tokens: the call of the tokenizer file without further special tokens."""
        if self._cut is None or not self._cut.search(text):
            return self.encode(text)
        return b"".join(np.asarray([self._added[part]], dtype="<u2").tobytes() if k % 2 else self.encode(part)
                        for k, part in enumerate(self._cut.split(text)))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
