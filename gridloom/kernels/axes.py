"""Clustering the lines of one axis: costs of stretches, the exact partition and the greedy one, over numpy arrays.

Lines are sorted by coord. Moving a line by d costs minus * d to the low side and plus * d to the high side, and it may leave
its place by low and high at most. A stretch of lines i..j becomes one line at the weighted median of their places, or as
near to it as all of them and the stretch's own extent allow. A stretch that begins with line i may end with line reach[i] at last.

The cost of a stretch, as a function of the place, is convex: left of all lines it falls by the sum of their minus, and
every line that the place passes raises the slope by its minus and plus. It is least where the slope turns.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np


#: Moves no longer than this are none.
STILL = 1e-9
#: Places that are priced at once.
PLACES = 1024


@lru_cache(16)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where i <= j in a square table, as a mask and as places."""
    upper = np.triu(np.ones((n, n), bool))
    return upper, *np.nonzero(upper)


@dataclass
class Axis:
    coord: np.ndarray
    minus: np.ndarray
    plus: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray | None = None

    def __post_init__(self):
        self.n, self.made = len(self.coord), {}
        if self.reach is None:
            self.reach = np.full(self.n, self.n - 1)
        self.floor, self.ceiling = self.coord - self.low, self.coord + self.high
        self.raised = np.cumsum(self.minus + self.plus)
        self.falls, self.rises = (np.concatenate(([0.0], np.cumsum(w))) for w in (self.minus, self.plus))

    def once(self, key: Hashable, make: Callable[[], Any]) -> Any:
        """What make gives, made when it is first asked for."""
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def turns(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each stretch i..j the first line behind which the slope is not negative: the plus of the stretch up to it is then
        no less than the minus of what follows it."""
        return np.clip(np.searchsorted(self.raised, self.rises[i] + self.falls[j + 1]), i, j)

    def moved(self, i: np.ndarray, j: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What it costs to move all lines of each stretch i..j to its place."""
        at, of = np.unique(place, return_inverse=True)
        out = np.empty(len(place))
        for k in range(0, len(at), PLACES):
            gap = self.coord - at[k : k + PLACES, None]
            total = np.cumsum(np.maximum(self.minus * gap, -self.plus * gap), axis=1)
            mine = np.flatnonzero((of >= k) & (of < k + PLACES))
            row = of[mine] - k
            out[mine] = total[row, j[mine]] - np.where(i[mine] > 0, total[row, i[mine] - 1], 0.0)
        return np.maximum(out, 0.0)

    def stretches(self, i: np.ndarray, j: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and place of each stretch i..j, given the highest floor and the lowest ceiling of its lines; infinite if none."""
        first, last = np.maximum(floor, self.coord[i]), np.minimum(ceiling, self.coord[j])
        can = (first - last <= 1e-12) & (j <= self.reach[i])
        cost, place = np.full(len(i), np.inf), np.full(len(i), np.nan)
        place[can] = np.minimum(np.maximum(self.coord[self.turns(i, j)], first), np.maximum(first, last))[can]
        cost[can] = self.moved(i[can], j[can], place[can])
        return cost, place

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Cost and place of every stretch as square tables; infinite below the diagonal."""
        upper, i, j = _upper(self.n)
        floor = np.maximum.accumulate(np.where(upper, self.floor, -np.inf), axis=1)
        ceiling = np.minimum.accumulate(np.where(upper, self.ceiling, np.inf), axis=1)
        cost, place = np.full((self.n, self.n), np.inf), np.full((self.n, self.n), np.nan)
        cost[i, j], place[i, j] = self.stretches(i, j, floor[i, j], ceiling[i, j])
        return cost, place


def frontier(costs: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The least total cost of 1..most stretches, and for each number where the last stretch of each prefix begins; of equal
    costs the first beginning."""
    n = len(costs)
    best, out, begins, every = np.concatenate(([0.0], np.full(n, np.inf))), [], [], np.arange(n)
    for _ in range(min(most, n)):
        tried = best[:n, None] + costs
        begins.append(at := tried.argmin(axis=0))
        best = np.concatenate(([np.inf], tried[at, every]))
        out.append(best[n])
    return np.array(out), begins


def exact_begins(begins: list[np.ndarray], n: int, k: int) -> np.ndarray:
    """Where the k stretches of the least cost begin."""
    at, end = [], n
    for level in range(k - 1, -1, -1):
        end = int(begins[level][end - 1])
        at.append(end)
    return np.array(at[::-1])


def greedy_merges(axis: Axis) -> tuple[list[int], list[float]]:
    """Neighbours merged one pair after the other, the cheapest rise first and of equals the first: the line at which the
    right one of each merged pair began, and the total cost after it."""
    begin, end = np.arange(axis.n), np.arange(axis.n)
    floor, ceiling, own = axis.floor.copy(), axis.ceiling.copy(), np.zeros(axis.n)

    def joined(at: np.ndarray) -> np.ndarray:
        cost, _ = axis.stretches(begin[at], end[at + 1], np.maximum(floor[at], floor[at + 1]), np.minimum(ceiling[at], ceiling[at + 1]))
        return cost

    cost = joined(np.arange(axis.n - 1))
    gone, totals = [], []
    while len(cost):
        rise = np.maximum(cost - own[:-1] - own[1:], 0.0)
        at = int(rise.argmin())
        if not np.isfinite(rise[at]):
            break
        gone.append(int(begin[at + 1]))
        own[at], end[at] = cost[at], end[at + 1]
        floor[at], ceiling[at] = max(floor[at], floor[at + 1]), min(ceiling[at], ceiling[at + 1])
        begin, end, floor, ceiling, own = (np.delete(v, at + 1) for v in (begin, end, floor, ceiling, own))
        cost = np.delete(cost, at)
        near = np.array([k for k in (at - 1, at) if 0 <= k < len(cost)], np.int64)
        cost[near] = joined(near)
        totals.append(float(own.sum()))
    return gone, totals


def places(axis: Axis, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cost and the place of each stretch, given where stretches begin."""
    ends = np.concatenate((begins[1:], [axis.n])) - 1
    floor, ceiling = np.maximum.reduceat(axis.floor, begins), np.minimum.reduceat(axis.ceiling, begins)
    return axis.stretches(begins, ends, floor, ceiling)
