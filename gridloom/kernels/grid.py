"""How many lines the two axes of a plan keep, and where, within a budget of cells; over numpy arrays.

An axis of n lines has n - 1 cells. Fewer lines cost more, so the numbers of both axes are chosen together.

What an axis can be cut into is kept with it, and a pass that forbids no further move on an axis gets the axis of the pass before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from gridloom.kernels.axes import STILL, Axis, exact_begins, frontier, greedy_merges, places

#: By how much cells may be narrower than asked.
SLACK = 1e-8


@dataclass(frozen=True)
class Budget:
    """What is asked of a grid; pairs are of x and y, None asks nothing.

    cells are numbers that an axis must have, most and most_cells bounds of an axis and of the product, width the least width of
    each cell. Without any bound an axis without a number gets the least it can have; with one, numbers are chosen by cost.
    Tolerances may grow to scale times theirs where the budget cannot be met, found by halving steps times."""

    cells: tuple[int | None, int | None] = (None, None)
    most: tuple[int | None, int | None] = (None, None)
    most_cells: int | None = None
    width: tuple[float | None, float | None] = (None, None)
    scale: float = 1.0
    steps: int = 24
    greedy: bool = False

    def __post_init__(self):
        counts = [c for c in (*self.cells, *self.most, self.most_cells) if c is not None]
        if any(c < 1 for c in counts) or any(w is not None and not 0 <= w < np.inf for w in self.width) or self.scale < 1 or self.steps < 1:
            raise ValueError("numbers of cells and steps are 1 or more, widths finite and not negative, the scale 1 or more")

    @property
    def bounded(self) -> bool:
        return any(m is not None for m in (*self.most, self.most_cells))


@dataclass(frozen=True)
class Lines:
    """The lines of one axis: where stretches begin, their places, and what moving to them costs."""

    begins: np.ndarray
    place: np.ndarray
    cost: float


def stretched(axis: Axis, scale: float) -> Axis:
    return axis if scale == 1 else axis.once(("stretched", scale), lambda: Axis(axis.coord, axis.minus, axis.plus, axis.low * scale, axis.high * scale, axis.reach))


def least_lines(axis: Axis, scale: float = 1.0) -> int:
    """Neighbours share a line as long as one place suits all of them, with tolerances times scale, and the first one's reach
    allows."""
    n, lo, hi, far = 0, np.inf, -np.inf, -1
    floor, ceiling = (axis.coord - axis.low * scale).tolist(), (axis.coord + axis.high * scale).tolist()
    for k, (least, most, reach) in enumerate(zip(floor, ceiling, axis.reach.tolist(), strict=True)):
        lo, hi = max(lo, least), min(hi, most)
        if lo > hi + 1e-12 or k > far:
            n, lo, hi, far = n + 1, least, most, reach
    return n


def room(axis: Axis, width: float | None) -> int:
    """How many cells of a width fit on the axis, no more than it has."""
    if not width:
        return axis.n - 1
    extent = axis.coord[-1] - axis.coord[0] + SLACK
    return 0 if extent < width else max(1, min(axis.n - 1, int(extent // width)))


def numbers(axes: list[Axis], budget: Budget, scale: float = 1.0) -> list[range] | None:
    """The numbers of cells that each axis may have beside the other's least one, with tolerances times scale; None if there are
    none."""
    out = []
    for axis, asked, most, width in zip(axes, budget.cells, budget.most, budget.width, strict=True):
        low = axis.once(("least", scale), lambda a=axis: least_lines(a, scale)) - 1
        high = min(m for m in (room(axis, width), most, budget.most_cells) if m is not None)
        if asked is not None:
            low, high = (asked, asked) if low <= asked <= high else (1, 0)
        elif not budget.bounded:
            high = min(low, high)
        out.append(range(low, high + 1))
    if budget.most_cells is not None and all(out):
        out = [range(mine.start, min(mine.stop, budget.most_cells // max(other.start, 1) + 1)) for mine, other in (out, out[::-1])]
    return out if all(out) else None


def widened(axis: Axis, begins: np.ndarray, width: float | None, table: tuple[np.ndarray, np.ndarray] | None = None) -> Lines | None:
    """Stretches at their cheapest places, looked up in the axis's table if given, or moved within their tolerances until neighbours
    are width apart."""
    ends = np.concatenate((begins[1:], [axis.n])) - 1
    cost, place = places(axis, begins) if table is None else (t[begins, ends] for t in table)
    if not width or (np.diff(place) + SLACK >= width).all():
        return Lines(begins, place, float(cost.sum()))
    gaps = np.arange(len(begins)) * width
    early = np.maximum.accumulate(np.maximum.reduceat(axis.floor, begins) - gaps)
    late = np.minimum.accumulate((np.minimum.reduceat(axis.ceiling, begins) - gaps)[::-1])[::-1]
    if (early > late + SLACK).any():
        return None
    place = np.maximum.accumulate(np.minimum(np.maximum(place - gaps, early), late)) + gaps
    return Lines(begins, place, float(axis.moved(begins, ends, place).sum()))


def choices(axis: Axis, cells: range, width: float | None, greedy: bool) -> dict[int, Lines]:
    """For each number of cells that can be had its lines: of the least cost before they are widened, or by greedy merges."""
    out, table = {}, None
    if greedy:
        gone, _ = axis.once("merges", lambda: greedy_merges(axis))
    else:
        table = axis.once("table", axis.table)
        costs, begins = axis.once(("frontier", cells.stop), lambda: frontier(table[0], cells.stop))

    def lines(n: int) -> Lines | None:
        if greedy:
            at = np.setdiff1d(np.arange(axis.n), gone[: axis.n - n - 1]) if axis.n - n - 1 <= len(gone) else None
        else:
            at = exact_begins(begins, axis.n, n + 1) if np.isfinite(costs[n]) else None
        return None if at is None else widened(axis, at, width, table)

    for n in cells:
        got = axis.once(("lines", n, width, greedy), lambda n=n: lines(n))
        if got is not None:
            out[n] = got
    return out


def fitted(axes: list[Axis], budget: Budget) -> list[Lines] | None:
    """Lines of both axes of the least cost; of equal costs those of fewer cells, then of more equal numbers, then of fewer in x."""
    cells = numbers(axes, budget)
    if cells is None:
        return None
    x, y = (choices(a, n, w, budget.greedy) for a, n, w in zip(axes, cells, budget.width, strict=True))
    pairs = ((i, j) for i in x for j in y if budget.most_cells is None or i * j <= budget.most_cells)
    best = min(pairs, key=lambda p: (x[p[0]].cost + y[p[1]].cost, p[0] * p[1], abs(p[0] - p[1]), p), default=None)
    return None if best is None else [x[best[0]], y[best[1]]]


def decided(axes: list[Axis], budget: Budget, scale: float = 1.0) -> tuple[list[Lines] | None, float]:
    """Lines of both axes, None if the budget cannot be met, and by how much tolerances had to grow from scale on."""
    can = lambda s: numbers(axes, budget, s) is not None
    if not can(scale):
        if not can(budget.scale):
            return None, scale
        low, scale = scale, budget.scale
        for _ in range(budget.steps):
            middle = (low + scale) / 2
            low, scale = (low, middle) if can(middle) else (middle, scale)
    got = fitted([stretched(a, scale) for a in axes], budget)
    if got is None and scale < budget.scale:
        scale = budget.scale
        got = fitted([stretched(a, scale) for a in axes], budget)
    return got, scale


@dataclass(frozen=True)
class Map:
    """The cells of one plan and the lines that bound its regions.

    load is by column and row, 0 where nothing is; spans are the low and high sides of columns and of rows; sides are those of
    each axis as arrays: the event, the load, and whether the region is beyond it."""

    load: np.ndarray
    spans: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    sides: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

    def gained(self, coords: list[np.ndarray], lines: list[np.ndarray], tolerance: float) -> dict[float, float]:
        """For each load the area over tolerance that its cells have, on lines that moved from coords, where a smaller load was.

        Sides without an event go with the event before them. A moved column's and a moved row's parts on the old ones tell the
        areas that all cells share."""
        length, shared = [], []
        for coord, line, (lo, hi) in zip(coords, lines, self.spans, strict=True):
            low, high = (np.where(at < 0, np.nan, line[np.maximum(at, 0)]) for at in (np.searchsorted(coord, v, "right") - 1 for v in (lo, hi)))
            there = high > low
            length.append(np.where(there, high - low, 0.0))
            part = np.minimum(high[:, None], hi) - np.maximum(low[:, None], lo)
            shared.append(np.where(there[:, None] & (part > 0), part, 0.0))
        out = {}
        for load, mine, allowed in self.masks:
            over = float(length[0] @ mine @ length[1] - (mine * (shared[0] @ allowed @ shared[1].T)).sum())
            if over > tolerance:
                out[load] = over
        return out

    @cached_property
    def masks(self) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each load with its cells and those of no smaller load, as ones."""
        return [(float(v), (self.load == v).astype(float), (self.load >= v).astype(float)) for v in np.unique(self.load[self.load > 0])]


@dataclass(frozen=True)
class Guarded:
    """How a plan came out: lines (None if its budget cannot be met), the moves forbidden on each axis to the low and the high
    side, the scale of tolerances, how often lines were chosen again, the largest area a load had gained, and what is wrong."""

    lines: list[Lines] | None
    locked: list[tuple[np.ndarray, np.ndarray]]
    scale: float
    passes: int
    worst: float
    problem: str | None


def guarded(axes: list[Axis], budget: Budget, cells: Map | None, tolerance: float) -> Guarded:
    """Lines within the budget; with cells, those moves are forbidden by which a load gained ground, until none did or no further
    move is to be forbidden."""
    locked = [(np.zeros(a.n, bool), np.zeros(a.n, bool)) for a in axes]
    scale, passes, worst, held = 1.0, 0, 0.0, list(axes)
    while True:
        got, scale = decided(held, budget, scale)
        if got is None or cells is None:
            return Guarded(got, locked, scale, passes, worst, "budget" if got is None else None)
        lines = [g.place[np.searchsorted(g.begins, np.arange(a.n), "right") - 1] for a, g in zip(axes, got, strict=True)]
        over = cells.gained([a.coord for a in axes], lines, tolerance)
        worst = max(worst, *over.values(), 0.0)
        more = [(low.copy(), high.copy()) for low, high in locked]
        for a, line, (low, high), (event, load, beyond) in zip(axes, lines, more, cells.sides, strict=True):
            by, counts = (line - a.coord)[event], (load[:, None] == np.array(list(over))).any(axis=1)
            low[event[counts & beyond & (by < -STILL)]] = True
            high[event[counts & ~beyond & (by > STILL)]] = True
        still = [all((now == was).all() for was, now in zip(pair, new, strict=True)) for pair, new in zip(locked, more, strict=True)]
        if all(still):
            return Guarded(got, locked, scale, passes, worst, "order" if over else None)
        locked, passes = more, passes + 1
        held = [h if same else Axis(a.coord, a.minus, a.plus, a.low * ~low, a.high * ~high, a.reach) for a, h, same, (low, high) in zip(axes, held, still, locked, strict=True)]
