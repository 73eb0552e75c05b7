"""Disjoint rectangles over a mask: for each number of them the least area that holds every one-cell exactly once, over plain numbers.

Cells are bits of an integer, row by row. The first one-cell that is still bare must be in some rectangle that is clear of what
is covered; what is covered then tells all about the rest, so each set of covered cells is solved once, for all numbers.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np


def rectangles(ones: np.ndarray, x: np.ndarray, y: np.ndarray, least: tuple[float, float], physical: bool, zeros: bool) -> list[tuple[int, float, tuple[int, int, int, int]]]:
    """Bits, cost and x0, y0, x1, y1 (indices, the ends past the last cell) of the rectangles that may be used.

    They hold a one-cell (only such cells, unless zeros may be covered) and are as wide and high as least asks. The cost is the
    number of cells, or the area where it is physical."""
    (ny, nx), out = ones.shape, []
    xs, ys = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    xs, ys = xs.tolist(), ys.tolist()
    inside = np.pad(ones.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))).tolist()
    row = lambda a, b: ((1 << (b - a)) - 1) << a
    for (y0, y1), (x0, x1) in itertools.product(itertools.combinations(range(ny + 1), 2), itertools.combinations(range(nx + 1), 2)):
        held, size = inside[y1][x1] - inside[y0][x1] - inside[y1][x0] + inside[y0][x0], (x1 - x0) * (y1 - y0)
        if xs[x1] - xs[x0] < least[0] - 1e-9 or ys[y1] - ys[y0] < least[1] - 1e-9 or held == 0 or (held < size and not zeros):
            continue
        bits = sum(row(x0, x1) << (nx * k) for k in range(y0, y1))
        out.append((bits, float((xs[x1] - xs[x0]) * (ys[y1] - ys[y0])) if physical else float(size), (x0, y0, x1, y1)))
    return out


def _tight(ones: np.ndarray, some: list[tuple[int, float, tuple]]) -> list[int]:
    """Which of some no best choice can do without: not those that may shrink to the box of the one-cells they hold, which is
    clear of all that they are clear of, and cost less there."""
    at, out = {place: cost for _, cost, place in some}, []
    lines = ones.tolist()
    for i, (_, cost, (x0, y0, x1, y1)) in enumerate(some):
        held = [(y, x) for y in range(y0, y1) for x in range(x0, x1) if lines[y][x]]
        ys, xs = [y for y, _ in held], [x for _, x in held]
        box = min(xs), min(ys), max(xs) + 1, max(ys) + 1
        if not at.get(box, cost) < cost - 1e-9:
            out.append(i)
    return out


def frontier(ones: np.ndarray, some: list[tuple[int, float, tuple]]) -> dict[int, tuple[float, list[int]]]:
    """For each possible number of rectangles of some the least total cost and which they are; of equal costs the first found."""
    each = [k for k, one in enumerate(ones.ravel().tolist()) if one]
    wanted = sum(1 << k for k in each)
    usable = [(i, *some[i][:2]) for i in _tight(ones, some)]
    holding = {1 << k: [r for r in usable if r[1] >> k & 1] for k in each}
    known: dict[int, dict[int, tuple[float, int]]] = {wanted: {0: (0.0, -1)}}

    def rest(covered: int) -> dict[int, tuple[float, int]]:
        if covered in known:
            return known[covered]
        bare = wanted & ~covered
        best: dict[int, tuple[float, int]] = {} if bare else {0: (0.0, -1)}
        for i, bits, cost in holding[bare & -bare] if bare else ():
            if not bits & covered:
                after = covered | bits
                for n, (paid, _) in (known[after] if after in known else rest(after)).items():
                    if n + 1 not in best or paid + cost < best[n + 1][0] - 1e-12:
                        best[n + 1] = paid + cost, i
        known[covered] = best
        return best

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(each) + 1000))
    out = {}
    for n, (total, _) in rest(0).items():
        chosen, covered = [], 0
        for k in range(n, 0, -1):
            i = known[covered][k][1]
            chosen.append(i)
            covered |= some[i][0]
        out[n] = total, sorted(chosen)
    return out
