"""Word shingles as 64-bit hashes, and prefix trees of shingle sets, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Words whose hash a worker keeps.
_KEEP = 200_000
#: Words of more bytes are hashed one by one.
_LONG = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class _Hashes(dict):
    """Hash of a word, computed once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > _KEEP:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; fewer words are one shingle as a whole, none give none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    width = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = mix(out * _K[0] + words[k:n - width + 1 + k] * _K[1 + k % 4])
    return out


def lower_ascii_words(text: str | None) -> list[bytes]:
    """A-Z lowered, cut at ASCII white space (what bytes.lower and bytes.split do)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_spans(texts: list[str | bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in lower case (A-Z) in one string, begin and end of its words, and how many each text has."""
    parts = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b" " + b" ".join(parts).lower() + b" " * 9  # nine, so that eight bytes can be read from any letter on
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    first = np.cumsum(np.array([1] + [len(p) + 1 for p in parts], dtype=np.int64))
    return data, begins, ends, np.diff(np.searchsorted(begins, first))


def text_hashes(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and how many words each has.

    Words as in ``lower_ascii_words``; the hashes are others than those of ``word_hashes``.
    """
    data, begins, ends, counts = word_spans(texts)
    return span_hashes(data, begins, ends), counts


def span_hashes(data: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words that ``word_spans`` gives, eight bytes at a time."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = ends - begins
    with np.errstate(over="ignore"):
        h = mix((eight[begins] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _K[0])
        more, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            left = size[more] - k
            h[more] = mix(h[more] * _K[1] + (eight[begins[more] + k] & _FIRST_BYTES[np.minimum(left, 8)]))
            more, k = more[left > 8], k + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begins[i]:ends[i]])
    return h


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(lower_ascii_words(text)), size))


def set_name(members: np.ndarray) -> int:
    """64-bit name of a set of hashes (signed)."""
    with np.errstate(over="ignore"):
        total = np.array([mix(members + _K[1]).sum(dtype=np.uint64) * _K[0] + np.uint64(len(members))])
    return int(mix(total).view(np.int64)[0])


class Links:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class PrefixTree:
    """Sets as paths of one global order of their members; common beginnings are stored and counted once.

    A node is a run of members without a branch. Queries walk the tree level by
    level: the overlap of a node is that of its parent plus the members of its
    run that the query has, and a subtree is left out when even all that can
    still follow would not reach the overlap that its smallest set needs.
    """

    def __init__(self, ranked: list[np.ndarray], vocabulary: int):
        order = sorted(range(len(ranked)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.has = np.zeros(vocabulary + 1, dtype=np.int32)
        self.sizes = np.array([len(r) for r in ranked], dtype=np.int64)
        self.sets_at: dict[int, list[int]] = {}
        parent, depth, path = [-1], [0], [order[0] if order else -1]  # node 0 is the root; path: a set through the node

        def add(up: int, deep: int, through: int) -> int:
            parent.append(up)
            depth.append(deep)
            path.append(through)
            return len(parent) - 1

        open_nodes = [0]
        previous = np.empty(0, dtype=np.int64)
        for i in order:
            s = ranked[i]
            m = min(len(previous), len(s))
            same = previous[:m] == s[:m]
            common = m if same.all() else int(np.argmin(same))
            below = 0
            while depth[open_nodes[-1]] > common:
                below = open_nodes.pop()
            if depth[open_nodes[-1]] < common:  # a branch inside a run
                parent[below] = add(open_nodes[-1], common, i)
                open_nodes.append(parent[below])
            if len(s) > common:
                open_nodes.append(add(open_nodes[-1], len(s), i))
            self.sets_at.setdefault(open_nodes[-1], []).append(i)
            previous = s
        n = len(parent)
        runs = [ranked[path[v]][depth[parent[v]]:depth[v]] for v in range(1, n)]
        self.depth, self.parent = np.array(depth, dtype=np.int64), np.array(parent, dtype=np.int64)
        self.tokens = np.concatenate(runs) if runs else np.empty(0, dtype=np.int64)
        self.start = np.concatenate([[0, 0], np.cumsum([len(r) for r in runs], dtype=np.int64)]).astype(np.int64)
        self.last = np.array([-1] + [r[-1] for r in runs], dtype=np.int64)
        least, most = np.full(n, 1 << 40, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for node, sets in self.sets_at.items():
            least[node], most[node] = self.sizes[sets].min(), self.sizes[sets].max()
        for node in np.argsort(-self.depth, kind="stable")[:-1].tolist():  # from the leaves up, without the root
            p = parent[node]
            least[p], most[p] = min(least[p], least[node]), max(most[p], most[node])
        self.least, self.most = least, most
        self.children = np.argsort(self.parent, kind="stable")[1:]
        bounds = np.searchsorted(self.parent[self.children], np.arange(n + 1))
        self.first, self.end = bounds[:-1], bounds[1:]

    def search(self, query: np.ndarray, num: int, den: int) -> Iterator[int]:
        """Positions of the sets y with den * overlap >= num * union."""
        x = len(query)
        self.has[query] = 1
        frontier = self.children[self.first[0]:self.end[0]]
        base = np.zeros(len(frontier), dtype=np.int64)
        while len(frontier):
            lengths = self.start[frontier + 1] - self.start[frontier]
            ends = np.cumsum(lengths)
            at = np.repeat(self.start[frontier] - (ends - lengths), lengths) + np.arange(ends[-1])
            got = np.add.reduceat(self.has[self.tokens[at]], ends - lengths)
            overlap = base + got
            rest = np.minimum(x - np.searchsorted(query, self.last[frontier], side="right"), self.most[frontier] - self.depth[frontier])
            # overlap o of sizes x, y is enough when (num + den) * o >= num * (x + y); more than o + rest cannot be reached
            alive = (num + den) * (overlap + rest) >= num * (x + self.least[frontier])
            frontier, overlap = frontier[alive], overlap[alive]
            for node, o in zip(frontier.tolist(), overlap.tolist()):
                for i in self.sets_at.get(node, ()):
                    if (num + den) * o >= num * (x + int(self.sizes[i])):
                        yield i
            counts = self.end[frontier] - self.first[frontier]
            ends = np.cumsum(counts)
            base, total = np.repeat(overlap, counts), int(ends[-1]) if len(ends) else 0
            frontier = self.children[np.repeat(self.first[frontier] - (ends - counts), counts) + np.arange(total)]
        self.has[query] = 0


def rank_sets(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets in one global order, the most shared members first, as increasing ranks."""
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), dtype=np.int64)
    rank[np.lexsort((every, -counts))] = np.arange(len(every))
    ends = np.cumsum([len(s) for s in sets])
    ranked = rank[inverse]
    return [np.sort(ranked[e - len(s):e]) for s, e in zip(sets, ends)], len(every)
