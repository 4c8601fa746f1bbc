"""Suffix buckets inside tasks: sampled positions of a text and the refinement of their buckets.

``anchors`` samples positions so that equal strings of LENGTH bytes are sampled
at equal offsets: of every run of gram positions that such a string spans, the
one with the least hash (leftmost of equals). ``refine`` sorts the suffixes (and,
mirrored, the prefixes) at sampled positions by bucket-pointer refinement.
"""

from __future__ import annotations

import numpy as np

from cadence.llm.shingles import mix

#: Texts are sampled in pieces of so many bytes, overlapping by a string, so that positions fit the low bits of a key.
_PIECE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        _POWERS[:] = [up, down]
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every ``gram`` consecutive bytes."""
    n = len(data)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])
        return mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a text (increasing), the hashes of the grams there, and the first and the last start of
    the strings of ``length`` that are sampled there; none if the text is shorter."""
    n = len(data)
    if n < length:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    if n > _PIECE:
        found = [(p + at, h, a + at, b + at) for at in range(0, n - length + 1, _PIECE - length + 1)
                 for p, h, a, b in [anchors(data[at:at + _PIECE], length, gram)]]
        pos, hashes, first, last = (np.concatenate(x) for x in zip(*found))
        pos, head = np.unique(pos, return_index=True)  # one at the edge of two pieces has its starts in both
        return pos, hashes[head], np.minimum.reduceat(first, head), np.maximum.reduceat(last, head)
    hashes = gram_hashes(data, gram)
    low = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)  # equal hashes: the leftmost is least
    width, have = length - gram + 1, 1
    while have < width:  # least of every ``width`` neighbours, by doubling
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], hashes[at[first]], first, last


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Order-preserving dense ranks of rows of keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def refine(bucket: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by (bucket, context bytes), their dense ranks, and the common prefix with the row before in that order.

    The first names are the 8-byte grams of the context themselves. The name of
    a span is refined by the name at the later offset where that span ends, and
    the refined names serve for the spans of twice the length, until one name
    covers the whole context; the bucket leads the last sort. A row of another
    bucket has the common prefix -1.
    """
    rows, width = context.shape
    padded = np.zeros((rows, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = context
    names = list(padded.view(">u8").T)
    while len(names) > 1:
        names = [_dense(names[i], names[i + 1]) if i + 1 < len(names) else names[i] for i in range(0, len(names), 2)]
    rank = _dense(bucket, names[0])
    order = np.argsort(rank, kind="stable")
    common = np.full(rows, -1, dtype=np.int64)
    if rows > 1:
        a, b = order[1:], order[:-1]
        differ = context[a] != context[b]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:][bucket[a] != bucket[b]] = -1
    return order, rank, common


def names_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row a name of its first ``depth`` context bytes within its bucket."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out
