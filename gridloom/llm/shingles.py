"""Hashed word shingles and SuperMinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct shingles of a text; remembers the hashes of a bounded number of words."""

    def __init__(self, words: int = WORDS, remembered: int = 100_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def hashes(self, text: bytes) -> np.ndarray:
        """Sorted hashes of the distinct shingles of a text whose letters A-Z count as a-z."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known, new = {}, set(words)
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - k + 1, np.uint64(k))
            for i in range(k):
                total = mixed(total * _ODD[i % len(_ODD)] + h[i : len(h) - k + 1 + i])
        return np.unique(total)


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The signature of a set of hashes: m numbers, of which two sets share each with a chance of their Jaccard similarity.

    Element d draws a permutation of the m places and, for the j-th place of it, the value j plus a fraction; a place keeps
    the least value it gets. All elements take their j-th step together; once every place holds a value of a step done, no
    later step can lower one, and the work ends: for sets larger than m after a step or two.
    """
    best = np.full(m, np.iinfo(np.uint64).max)
    n, order = len(elements), None
    rows = np.arange(n)
    for j in range(m if n else 0):
        with np.errstate(over="ignore"):
            x = mixed(elements + np.uint64(j + 1) * _C)
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(j << 32) | (x >> np.uint64(32))
        if order is None and j:
            order = np.tile(np.arange(m, dtype=np.int16), (n, 1))
            order[rows, first] = 0
            order[:, 0] = first
        place = k if order is None else order[rows, k]
        np.minimum.at(best, place, value)
        if j == 0:
            first = k
        else:
            order[rows, k] = order[rows, j]
            order[rows, j] = place
        if int(best.max()) >> 32 <= j:
            break
    return best


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of the signature."""
    rows = signature.reshape(bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for c in rows.T:
            key = mixed(key * _C + c)
    return key
