"""Counts over one text, used inside tasks. Words are runs of anything but ASCII white space."""

from __future__ import annotations

import numpy as np

SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Words in a window looked up for repeats.
WINDOW = 5


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Dense integers of the words, equal words equal, and how many there are."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    return ids, len(seen)


def window_names(ids: np.ndarray, distinct: int, size: int = WINDOW) -> np.ndarray:
    """Integers of the windows of ``size`` ids, equal windows equal, without collisions."""
    if distinct ** size < 1 << 62:
        out = ids[:len(ids) - size + 1].copy()
        for k in range(1, size):
            out *= distinct
            out += ids[k:len(ids) - size + 1 + k]
        return out
    names, width = ids, 1
    while width < size:  # name windows of twice the width, the last pair overlapping
        step = min(width, size - width)
        base = int(names.max()) + 1
        pairs = names[:len(names) - step] * base + names[step:]
        _, names = np.unique(pairs, return_inverse=True)
        width += step
    return names


def covered_by_repeats(names: np.ndarray, n: int, size: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that occurs twice or more."""
    _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    if len(counts) == len(names):
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:n]) > 0


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (see the quality rules)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(SPACE))
            else:
                seen.add(line)
    repeat = 0
    if n > WINDOW:
        ids, distinct = word_ids(words)
        repeat = int(covered_by_repeats(window_names(ids, distinct), n).sum())
    return n, chars, symbols, dup, repeat
