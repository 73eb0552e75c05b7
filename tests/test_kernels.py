import itertools
import random

import numpy as np

from gridloom.kernels import cover
from gridloom.kernels.axes import Axis, exact_begins, frontier, greedy_merges, places


def brute(covers, need, cost, most, n):
    best = None
    for pick in itertools.combinations_with_replacement(range(len(cost)), n):
        if all(pick.count(c) <= most[c] for c in set(pick)) and (covers[list(pick)].sum(axis=0) >= need).all():
            total = cost[list(pick)].sum()
            best = total if best is None else min(best, total)
    return best


def test_exact_cover_against_every_choice():
    rnd = random.Random(1)
    seen = set()
    for _ in range(200):
        c, r, n = rnd.randint(1, 7), rnd.randint(0, 5), rnd.randint(1, 4)
        covers = np.array([[rnd.random() < 0.5 for _ in range(r)] for _ in range(c)], bool).reshape(c, r)
        need = np.array([rnd.choice([1, 1, 2]) for _ in range(r)], np.int64)
        cost = np.array([rnd.randint(1, 20) for _ in range(c)], float)
        most = np.array([rnd.randint(1, 2) for _ in range(c)])
        status, total, zones = cover.solve(covers, need, cost, most, n)
        want = brute(covers, need, cost, most, n)
        seen.add(status)
        assert (total, status) == (want, "infeasible" if want is None else "optimal")
        if want is not None:
            assert len(zones) == n and cost[zones].sum() == want and (covers[zones].sum(axis=0) >= need).all()
        start = cover.greedy(covers, need, cost, most, n)
        assert start is None or (want is not None and len(start) == n and cost[start].sum() >= want)
    assert seen == {"optimal", "infeasible"}


def test_parts_share_the_number():
    """Candidates in blocks that share no row: every way to share n among the blocks is weighed, spare candidates included."""
    rnd = random.Random(2)
    for _ in range(60):
        blocks = [np.array([[rnd.random() < 0.6 for _ in range(2)] for _ in range(2)], bool) for _ in range(3)]
        covers = np.zeros((7, 6), bool)
        for k, b in enumerate(blocks):
            covers[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = b
        need, cost = np.array([rnd.choice([0, 1, 1, 2]) for _ in range(6)]), np.array([float(rnd.randint(1, 9)) for _ in range(7)])
        most = np.array([rnd.randint(0, 3) for _ in range(7)])
        for n in range(1, 6):
            status, total, zones = cover.solve(covers, need, cost, most, n)
            want = brute(covers, need, cost, most, n)
            assert (total, status) == (want, "infeasible" if want is None else "optimal")
            if want is not None:
                assert len(zones) == n and cost[zones].sum() == want and (covers[zones].sum(axis=0) >= need).all() and (np.bincount(zones, minlength=7) <= most).all()


def test_a_large_cover_ends():
    """A grid of 12 x 12 cells, all rectangles up to 6 x 6 as candidates, exact without a clock."""
    sides = [(x, y, w, h) for w in range(1, 7) for h in range(1, 7) for x in range(13 - w) for y in range(13 - h)]
    covers = np.zeros((len(sides), 12, 12), bool)
    for k, (x, y, w, h) in enumerate(sides):
        covers[k, x : x + w, y : y + h] = True
    cost = np.array([w * h + 3.0 for _, _, w, h in sides])
    status, total, zones = cover.solve(covers.reshape(len(sides), -1), np.ones(144, np.int64), cost, np.ones(len(sides), np.int64), 4)
    assert (status, total) == ("optimal", 156.0) and len(zones) == 4


def test_partitions_against_every_cut():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        costs = np.where(rnd.random((n, n)) < 0.2, np.inf, rnd.integers(0, 50, (n, n)).astype(float))
        costs[np.tril_indices(n, -1)] = np.inf
        got, begins = frontier(costs, n)
        for k in range(1, n + 1):
            cuts = (np.array([0, *c, n]) for c in itertools.combinations(range(1, n), k - 1))
            assert got[k - 1] == min(sum(costs[a, b - 1] for a, b in itertools.pairwise(c)) for c in cuts)
            if np.isfinite(got[k - 1]):
                at = [*exact_begins(begins, n, k), n]
                assert len(at) == k + 1 and sum(costs[a, b - 1] for a, b in itertools.pairwise(at)) == got[k - 1]


def lines(rnd, n):
    coord = np.sort(rnd.choice(200, n, replace=False)).astype(float)
    return Axis(coord, *(rnd.integers(0, 9, n).astype(float) for _ in range(2)), *(rnd.integers(0, 60, n).astype(float) for _ in range(2)))


def test_stretch_costs_against_every_place():
    """Two lines at 0 and 10 that may move by 6 meet between them; others, wherever the cost is least within all bounds."""
    cost, place = Axis(np.array([0.0, 10.0]), *(np.array([1.0, 1.0]),) * 2, *(np.array([6.0, 6.0]),) * 2).table()
    assert cost[0, 1] == 10 and 4 <= place[0, 1] <= 6
    rnd = np.random.default_rng(3)
    for _ in range(60):
        axis = lines(rnd, 7)
        cost, place = axis.table()
        for i, j in itertools.combinations_with_replacement(range(7), 2):
            low, high = max(axis.coord[i], axis.floor[i : j + 1].max()), min(axis.coord[j], axis.ceiling[i : j + 1].min())
            moves = lambda q: sum(m * max(0, c - q) + p * max(0, q - c) for c, m, p in zip(axis.coord[i : j + 1], axis.minus[i : j + 1], axis.plus[i : j + 1]))  # noqa: B023, B905, E731
            if low > high:
                assert np.isinf(cost[i, j])
            else:
                assert low <= place[i, j] <= high and abs(cost[i, j] - moves(place[i, j])) < 1e-6
                assert abs(cost[i, j] - min(map(moves, [low, high, *(c for c in axis.coord if low <= c <= high)]))) < 1e-6


def test_greedy_against_plain_merging_and_exact():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        axis = lines(rnd, 8)
        cost, _ = axis.table()
        cuts, want = list(range(8)) + [8], []
        while len(cuts) > 2:
            rises = [(max(0.0, cost[a, c - 1] - cost[a, b - 1] - cost[b, c - 1]), k + 1) for k, (a, b, c) in enumerate(zip(cuts, cuts[1:], cuts[2:]))]  # noqa: B905
            rise, at = min(rises)
            if not np.isfinite(rise):
                break
            want.append(cuts.pop(at))
        gone, totals = greedy_merges(axis)
        assert gone == want
        best, _ = frontier(cost, 8)
        for k, total in enumerate(totals):
            begins = np.setdiff1d(np.arange(8), gone[: k + 1])
            assert abs(places(axis, begins)[0].sum() - total) < 1e-6 and total > best[len(begins) - 1] - 1e-6
