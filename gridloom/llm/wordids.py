"""Ids of words seen before, kept in flat arrays so that a whole text's ids are gathered at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Sequence
from itertools import count

import numpy as np


class WordIds:
    """Remembers the ids of `remembered` words at most; beyond that it starts anew."""

    def __init__(self, remembered: int):
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[Hashable, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def keep(self, words: Sequence[Hashable], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words, which are new and distinct: all their ids in a row, and how many each has."""
        k, n, used = len(self.place), len(words), self.used + len(ids)
        while k + n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : used] = ids
        self.starts[k : k + n], self.sizes[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.place.update(zip(words, range(k, k + n), strict=True))
        self.used = used

    def gather(self, words: Sequence[Hashable]) -> np.ndarray:
        """The ids of words that are all known, in a row."""
        return self.gathered(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))

    def gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers, in a row."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[at] - ends + sizes, sizes)]


class Numbered(WordIds):
    """Words get their numbers when they are first asked for, their ids later."""

    def forget(self) -> None:
        super().forget()
        self.place = defaultdict(count().__next__)

    def keep(self, words: Sequence[Hashable], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words that have numbers but no ids."""
        used = self.used + len(ids)
        while len(self.place) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.flat[self.used : used] = ids
        self.starts[at], self.sizes[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = used
