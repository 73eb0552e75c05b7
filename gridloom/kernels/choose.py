"""Choosing final places of a plan's zones: a lexicographic score of one zone among the others, descent, and repair of contacts.

Zones have bars from x0 on, one each step, the last at the step nearest to x1. Only x0 and x1 are chosen; y0 and y1 are given.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

EPS = 1e-8
#: What an overlap of zones that should be in contact counts against a wrong distance; a fixed value.
CROSSED = 1000
#: How many pairs of places a plan remembers the bars of.
REMEMBERED = 100_000

Place = tuple[float, float]


def bars(x0: float, x1: float, step: float) -> list[float]:
    return [x0 + step * k for k in range(round((x1 - x0) / step) + 1)]


def nearest(a: list[float], b: list[float]) -> float:
    """The least distance of two bars at different places, both in ascending order; infinite if there are none."""
    least = math.inf
    for v in a:
        k = n = bisect_left(b, v)
        while k and v - b[k - 1] <= EPS:
            k -= 1
        if k and v - b[k - 1] < least:
            least = v - b[k - 1]
        while n < len(b) and b[n] - v <= EPS:
            n += 1
        if n < len(b) and b[n] - v < least:
            least = b[n] - v
    return least


def wanted_phase(a: int, b: int, module: int, gap: float) -> float:
    """How far bars at step a should stand from bars at step b."""
    big, small = max(a, b), min(a, b)
    if big == small:
        return big / 2 if big == module else 0.0
    if big == 2 * small:
        return big / 3 if small >= 3 * gap else small / 2
    common = math.gcd(a, b)
    return common / 2 if common < small and common >= 2 * gap else 0.0


@dataclass
class Plan:
    """Arrays by zone; old is (n, 4), served has the x0 and x1 of the boxes of each zone by box, contacts pairs (left, right)."""

    old: np.ndarray
    y: np.ndarray
    cls: np.ndarray
    step: np.ndarray
    stage: np.ndarray
    served: list[dict[int, tuple[float, float]]]
    contacts: list[tuple[int, int]]
    room: tuple[float, float]
    gap: float
    x: np.ndarray

    def __post_init__(self):
        self.n = len(self.cls)
        side = np.minimum(self.y[:, None, 1], self.y[None, :, 1]) - np.maximum(self.y[:, None, 0], self.y[None, :, 0])
        both = np.minimum(self.old[:, None, 2:], self.old[None, :, 2:]) - np.maximum(self.old[:, None, :2], self.old[None, :, :2])
        new = (self.cls[:, None] == self.cls[None, :]) & (np.clip(both, 0, None).prod(axis=2) <= EPS)
        self.steps, stage, ys, olds = self.step.tolist(), self.stage.tolist(), self.y.tolist(), self.old.tolist()
        self.module = math.lcm(*map(int, self.steps)) if self.n else 1
        self.heights = [y1 - y0 for y0, y1 in ys]
        self.was = [(o[0], o[2], abs(y[0] - o[1]) + abs(y[1] - o[3])) for o, y in zip(olds, ys, strict=True)]
        #: Zones that run beside each, and of these the ones that are needed no later: (zone, how far, whether an overlap is new, phase).
        self.along: list[set[int]] = [set() for _ in range(self.n)]
        self.near: list[list[tuple]] = [[] for _ in range(self.n)]
        for i, j in np.argwhere(side > 0).tolist():
            if i != j:
                self.along[i].add(j)
                if stage[j] <= stage[i]:
                    phase = self._phase(i, j) if self.served[i].keys() & self.served[j].keys() else None
                    self.near[i].append((j, float(side[i, j]), bool(new[i, j]), phase))
        self.touch: list[list[Place]] = [[] for _ in range(self.n)]
        for a, b in self.contacts:
            for i in {a, b}:
                if stage[a] <= stage[i] and stage[b] <= stage[i]:
                    self.touch[i].append((a, b))
        #: Whose places a zone's score depends on, its own aside.
        self.around = [{j for j, *_ in near} | {z for c in touch for z in c if z != i} for i, (near, touch) in enumerate(zip(self.near, self.touch, strict=True))]
        self.meetings: dict[tuple, tuple[float, frozenset]] = {}

    def _phase(self, i: int, j: int) -> tuple[int, float]:
        a, b = int(self.steps[i]), int(self.steps[j])
        return math.gcd(a, b), wanted_phase(a, b, self.module, self.gap)

    def meeting(self, a: tuple, b: tuple) -> tuple[float, frozenset]:
        """Of bars within the width that two zones (x0, x1, step) share the least distance of two at different places, and the
        places that both have a bar at."""
        got = self.meetings.get((a, b))
        if got is None:
            low, high = max(a[0], b[0]) - EPS, min(a[1], b[1]) + EPS
            one, two = ([v for v in bars(*z) if low <= v <= high] for z in (a, b))
            if len(self.meetings) >= REMEMBERED:
                self.meetings.clear()
            got = self.meetings[a, b] = self.meetings[b, a] = nearest(one, two), frozenset(one).intersection(two)
        return got

    def _uncovered(self, i: int, x0: float, x1: float) -> tuple:
        """Boxes at the room's sides that are missed, and others that are missed by more than a step, with by how much."""
        edge = inner = 0
        missed, extra = 0.0, 0.0
        for low, high in self.served[i].values():
            off = max(0.0, x0 - low, high - x1)
            if low <= self.room[0] + EPS or high >= self.room[1] - EPS:
                if off > EPS:
                    edge, missed = edge + 1, missed + off
            elif off - self.steps[i] > EPS:
                inner, extra = inner + 1, extra + (off - self.steps[i])
        return edge, missed, inner, extra

    def _touching(self, i: int, x0: float, x1: float, x: list[Place]) -> tuple:
        count = far = 0
        for a, b in self.touch[i]:
            apart = (x0 if b == i else x[b][0]) - (x1 if a == i else x[a][1])
            off = -apart if apart < -EPS else abs(apart - self.steps[a])
            if off > EPS:
                count, far = count + (CROSSED if apart < -EPS else 1), far + off
        return count, far

    def _parts(self, i: int, x0: float, x1: float, x: list[Place]) -> Iterator[tuple]:
        """The score of zone i at x0..x1, the others at x, in parts that are worked out when they are asked for."""
        shared = [(j, w, side, new, phase) for j, side, new, phase in self.near[i] if (w := min(x[j][1], x1) - max(x[j][0], x0)) >= 0]
        if not shared:
            yield 0, 0.0, 0, 0, 0.0
        else:
            over = [a for _, w, side, new, _ in shared if new and (a := w * side) > EPS]
            yield len(over), float(sum(over))
            own = (x0, x1, self.steps[i])
            met = [self.meeting(own, (*x[j], self.steps[j])) for j, *_ in shared]
            at = [(z[0], same) for z, (_, same) in zip(shared, met, strict=True) if same]
            yield (sum(len(p & q) for (j, p), (k, q) in itertools.combinations(at, 2) if k in self.along[j]),)
            lacks = [self.gap - far for z, (far, _) in zip(shared, met, strict=True) if z[1] > 0 and far < self.gap - EPS]
            yield len(lacks), sum(lacks, 0.0)
        yield self._uncovered(i, x0, x1)
        yield self._touching(i, x0, x1, x)
        phases, off = 0, 0.0
        for j, w, _, _, phase in shared:
            if phase and w > 0:
                common, want = phase
                wrong = min(min(d := (x0 - x[j][0] - v) % common, common - d) for v in (want, -want))
                if wrong > EPS:
                    phases, off = phases + 1, off + wrong
        yield phases, off
        was0, was1, across = self.was[i]
        yield (x1 - x0) * self.heights[i], abs(x0 - was0) + abs(x1 - was1) + across

    def score(self, i: int, x0: float, x1: float) -> tuple:
        """What is wrong with zone i at x0..x1 among zones that are needed no later, worst first: new overlaps with its class
        (number, area), triples of bars, close bars (number, lack), boxes missed at the room's sides and elsewhere (number, by
        how much), contacts, phases to zones with boxes in common, its area, and how far it moved."""
        return self._score(i, float(x0), float(x1), list(map(tuple, self.x.tolist())))

    def scores(self) -> list[tuple]:
        """The score of each zone where it is."""
        x = list(map(tuple, self.x.tolist()))
        return [self._score(i, *x[i], x) for i in range(self.n)]

    def _score(self, i: int, x0: float, x1: float, x: list[Place]) -> tuple:
        return tuple(itertools.chain.from_iterable(self._parts(i, x0, x1, x)))

    def better(self, i: int, place: Place, x: list[Place], best: tuple) -> tuple | None:
        """The score of zone i at a place if it is less than best; the first part that differs tells."""
        got: tuple = ()
        less = False
        for part in self._parts(i, *place, x):
            if not less:
                other = best[len(got) : len(got) + len(part)]
                if part > other:
                    return None
                less = part < other
            got += part
        return got if less else None

    def faults(self) -> tuple[int, int]:
        """How many triples of bars at one place and pairs of zones with bars that are too close the whole plan has."""
        zones = [(*x, s) for x, s in zip(self.x.tolist(), self.steps, strict=True)]
        triples = close = 0
        for i, own in enumerate(zones):
            met = {j: self.meeting(own, zones[j]) for j in sorted(self.along[i]) if j > i and min(own[1], zones[j][1]) >= max(own[0], zones[j][0])}
            close += sum(far < self.gap - EPS for far, _ in met.values())
            at = [(j, same) for j, (_, same) in met.items() if same]
            triples += sum(len(p & q) for (j, p), (k, q) in itertools.combinations(at, 2) if k in self.along[j])
        return triples, close


def _places(options: list) -> list[list[Place]]:
    return [[(float(a), float(b)) for a, b in some] for some in options]


def choose(plan: Plan, options: list, passes: int) -> None:
    """Sets plan.x: at first the smallest option that moves least, then, stage by stage, whatever option improves a zone's score,
    in turns through the zones forth and back, until none does or passes are over."""
    options = _places(options)
    x = [min(some, key=lambda o, was=was: (o[1] - o[0], abs(o[0] - was[0]) + abs(o[1] - was[1]))) for some, was in zip(options, plan.was, strict=True)]
    for stage in np.unique(plan.stage):
        zones = np.flatnonzero(plan.stage == stage).tolist()
        moved, seen, turns = dict.fromkeys(range(plan.n), 0), dict.fromkeys(zones, -1), 0
        for turn in range(passes):
            changed = False
            for i in zones[:: 1 if turn % 2 == 0 else -1]:
                turns += 1
                if all(moved[j] < seen[i] for j in plan.around[i]) and seen[i] > 0:
                    continue  # it has the best of its options among zones that stand where they stood
                best, seen[i] = plan._score(i, *x[i], x), turns
                for place in options[i]:
                    if place != x[i] and (key := plan.better(i, place, x, best)) is not None:
                        best, x[i], changed, moved[i] = key, place, True, turns
            if not changed:
                break
    plan.x = np.array(x, float).reshape(-1, 2)


def _joined(zones: list[int], contacts: list[tuple[int, int]]) -> list[list[int]]:
    """zones in groups that contacts join, each in an order in which every zone but the first has a contact before it."""
    near: dict[int, set[int]] = {z: set() for z in zones}
    for a, b in contacts:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for z in zones:
        if z not in seen and near[z]:
            order = [z]
            for y in order:
                order += sorted(near[y].difference(order))
            seen.update(order)
            out.append(order)
    return out


def mend(plan: Plan, options: list) -> None:
    """Moves zones in contact, group by group, to the options that stand exactly the smaller of their steps apart, with the least
    movement and then the least width of all such choices, unless the plan gets more triples or close bars by it."""
    options, x, faults = _places(options), plan.x.tolist(), None
    for order in _joined(list(range(plan.n)), plan.contacts):
        place = {z: k for k, z in enumerate(order)}
        gaps = [[] for _ in order]
        for a, b in plan.contacts:
            if a in place:
                last = max(a, b, key=place.__getitem__)
                gaps[place[last]].append((a, b, min(plan.steps[a], plan.steps[b])))
        costs = [[abs(a - x[z][0]) + abs(b - x[z][1]) for a, b in options[z]] for z in order]
        ranks = [sorted(range(len(c)), key=lambda r, z=z, c=c: (c[r], options[z][r][1] - options[z][r][0], options[z][r][0])) for z, c in zip(order, costs, strict=True)]
        rest = [*itertools.accumulate(map(min, costs[::-1]))][::-1] + [0.0]
        best: tuple | None = None
        chosen: dict[int, Place] = {}

        def walk(k: int, cost: float, width: float) -> None:
            nonlocal best
            if best is not None and (cost + rest[k] > best[0] + EPS):
                return
            if k == len(order):
                if best is None or (cost, width) < (best[0] - EPS, 0) or (cost <= best[0] + EPS and width < best[1] - EPS):
                    best = cost, width, dict(chosen)
                return
            for r in ranks[k]:
                if best is not None and cost + costs[k][r] + rest[k + 1] > best[0] + EPS:
                    break
                chosen[order[k]] = options[order[k]][r]
                if all(abs(chosen[b][0] - chosen[a][1] - t) <= EPS for a, b, t in gaps[k]):
                    walk(k + 1, cost + costs[k][r], width + chosen[order[k]][1] - chosen[order[k]][0])
            chosen.pop(order[k], None)

        walk(0, 0.0, 0.0)
        if best is not None:
            before, had = plan.faults() if faults is None else faults, plan.x.copy()
            for z, place in best[2].items():
                plan.x[z] = place
            faults = plan.faults()
            if faults > before:
                plan.x, faults = had, before
