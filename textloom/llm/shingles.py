"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .runtime import CACHES

WIDTH = 5
CACHE_WORDS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
CACHES["shingles"] = _HASHES.clear


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space."""
    return text.lower().split() if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of every run of ``width`` words; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    width = min(width, len(hashes))
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * _MULTIPLIER + hashes[i : i + n]
    return mix(out)


def occurrences(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values, and for each how many equal ones stand before it."""
    v = np.sort(values)
    at = np.arange(len(v))
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    return v, at - np.maximum.accumulate(np.where(first, at, 0))


def cells(values: np.ndarray) -> np.ndarray:
    """A multiset as a set: the j-th copy of a value has a hash of its own.

    Jaccard similarity of such sets is the weighted Jaccard similarity of the
    multisets, sum of minima over sum of maxima.
    """
    v, nth = occurrences(values)
    return mix(v + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
