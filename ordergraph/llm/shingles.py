"""Hashed word shingles of a text, for tasks (numpy, no Spark)."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class WordHashes(dict):
    """64-bit hashes of words, kept for the most recent million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[0]
    x = (x ^ (x >> np.uint64(27))) * ODD[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of the whole text.

    Words are separated by ASCII white space, A-Z in lower case; a text of
    fewer words is one shingle; none without words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    total = np.full(n, np.uint64(len(words)) if len(words) < size else np.uint64(0), dtype=np.uint64)
    for i in range(k):
        total = mixed(total * MIX + h[i : i + n])
    return np.unique(total)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers; arrays sorted and distinct."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
