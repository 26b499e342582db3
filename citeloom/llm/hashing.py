"""Hashes of words and of runs of values, vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words (runs of non-blank characters), A-Z lower-cased."""
    tokens = text.encode().lower().split()
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n values, by doubling: a run of 2m is two runs of m."""
    count = len(values) - n + 1
    have, size, base, out, at, left = values, 1, int(ODD), None, 0, n
    while True:
        if left & 1:
            piece = have[at : at + count]
            out = piece if out is None else out * np.uint64(base) + piece
            at += size
        left >>= 1
        if not left:
            return out
        have, size, base = have[:-size] * np.uint64(base) + have[size:], 2 * size, base * base % (1 << 64)


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    low, width = values, 1
    while 2 * width <= n:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    count = len(values) - n + 1
    return np.minimum(low[:count], low[n - width : n - width + count])
