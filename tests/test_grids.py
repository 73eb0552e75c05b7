"""Grids within a budget of cells, and loads that gain no ground: every partition, and a plain loop over squares."""

import itertools
import random

import numpy as np
import pytest
from test_queries import SF

from gridloom.kernels.axes import Axis
from gridloom.kernels.grid import Budget, Map, decided, guarded, least_lines, numbers, stretched, widened
from gridloom.operators import grids, quantise
from gridloom.plans import quantise_queries as q
from gridloom.plans.cover import Cover


def some_axis(rnd, n):
    coord = np.array(sorted(rnd.sample(range(40), n)), float)
    w, t = (np.array([[rnd.randint(0, 9) for _ in range(n)] for _ in range(2)], float) for _ in range(2))
    t[:, [0, -1]] = 0
    return Axis(coord, w[0] + 1, w[1] + 1, t[0], t[1])


def cheapest(axis, i, j):
    """The least cost of one place for lines i to j, by trying every place where it can turn."""
    lo, hi = max(axis.floor[i : j + 1].max(), axis.coord[i]), min(axis.ceiling[i : j + 1].min(), axis.coord[j])
    if lo > hi:
        return np.inf
    return min(sum(max(axis.minus[k] * (axis.coord[k] - p), axis.plus[k] * (p - axis.coord[k])) for k in range(i, j + 1)) for p in (lo, hi, *(c for c in axis.coord if lo < c < hi)))


def every_number(axis):
    """Least cost of each number of cells, by every partition."""
    best = {}
    for k in range(axis.n):
        for cut in itertools.combinations(range(1, axis.n), k):
            at = [0, *cut, axis.n]
            cost = sum(cheapest(axis, a, b - 1) for a, b in itertools.pairwise(at))
            if np.isfinite(cost):
                best[k] = min(best.get(k, cost), cost)
    return best


def test_budgets_against_every_partition():
    rnd, told, tried = random.Random(4), 0, 0
    for _ in range(150):
        axes = [some_axis(rnd, rnd.randint(2, 7)) for _ in "xy"]
        costs = [every_number(a) for a in axes]
        assert [least_lines(a) - 1 for a in axes] == [min(c) for c in costs]
        pick = lambda low, high: rnd.choice([None, rnd.randint(low, high)])
        budget = Budget(cells=(pick(1, 6), pick(1, 6)), most=(pick(2, 6), pick(2, 6)), most_cells=pick(2, 25))
        ways = []
        for i, j in itertools.product(*costs):
            fits = all(n >= 1 and asked in (None, n) and (most is None or n <= most) for n, asked, most in zip((i, j), budget.cells, budget.most, strict=True))
            least = budget.bounded or all(asked is not None or n == min(c) for n, asked, c in zip((i, j), budget.cells, costs, strict=True))
            if fits and least and (budget.most_cells is None or i * j <= budget.most_cells):
                ways.append((round(costs[0][i] + costs[1][j], 6), i * j, abs(i - j), i, j))
        got, scale = decided(axes, budget)
        assert scale == 1 and (got is None) == (not ways)
        if got is None:
            told += 1
        else:
            tried += 1
            assert (round(got[0].cost + got[1].cost, 6), *(len(g.begins) - 1 for g in got)) == (min(ways)[0], *min(ways)[3:])
    assert told > 10 and tried > 50


def test_widths_and_scales():
    rnd, seen = random.Random(5), set()
    for _ in range(150):
        axes = [some_axis(rnd, rnd.randint(3, 8)) for _ in "xy"]
        budget = Budget(most_cells=rnd.randint(2, 16), width=(rnd.randint(1, 6), None), scale=3.0)
        got, scale = decided(axes, budget)
        if got is None:
            seen.add("none")
            continue
        seen.add("grown" if scale > 1 else "still")
        wide = [stretched(a, scale) for a in axes]
        assert (np.diff(got[0].place) >= budget.width[0] - 1e-6).all() and (len(got[0].begins) - 1) * (len(got[1].begins) - 1) <= budget.most_cells
        for axis, lines in zip(wide, got, strict=True):
            at = lines.place[np.searchsorted(lines.begins, np.arange(axis.n), "right") - 1]
            assert (at >= axis.floor - 1e-6).all() and (at <= axis.ceiling + 1e-6).all() and (np.diff(at) >= -1e-9).all()
            assert abs(np.maximum(axis.minus * (axis.coord - at), axis.plus * (at - axis.coord)).sum() - lines.cost) < 1e-6
        if 1 < scale < 3:  # no smaller scale that halving meets would do
            assert numbers([stretched(a, scale - 3 * 2.0**-24) for a in axes], budget) is None
    assert seen == {"none", "grown", "still"}


def test_budgets_that_cannot_be():
    for how in ({"cells": (0, None)}, {"most_cells": 0}, {"width": (-1, None)}, {"width": (float("nan"), None)}, {"scale": 0.5}, {"steps": 0}):
        with pytest.raises(ValueError):
            Budget(**how)


def plain_guard(events, cells, x, y, budget, tolerance):
    """The loop over one plan: lines, then areas by spans, then locks."""
    locks, scale, passes, worst = set(), 1.0, 0, 0.0
    names = ("x", "y")
    while True:
        axes = []
        for a in names:
            e = events[a]
            low, high = ([0.0 if (a, r["idx"], d) in locks else float(r[f"tol_{d}"]) for r in e] for d in ("minus", "plus"))
            axes.append(Axis(*(np.array([float(r[c]) for r in e]) for c in ("coord", "w_minus", "w_plus")), np.array(low), np.array(high)))
        got, scale = decided(axes, budget, scale)
        if got is None:
            return None, locks, scale, passes, worst, "budget"
        to = {a: dict(zip((r["coord"] for r in events[a]), g.place[np.searchsorted(g.begins, np.arange(len(events[a])), "right") - 1], strict=True)) for a, g in zip(names, got, strict=True)}
        at = lambda a, v: to[a][max(c for c in to[a] if c <= v)]
        gained, old = {}, {k: v for k, v in cells.items() if v}
        for (i, j), load in old.items():
            s = (at("x", x[i][0]), at("y", y[j][0]), at("x", x[i][1]), at("y", y[j][1]))
            if s[2] > s[0] and s[3] > s[1]:
                held = sum(max(0, min(s[2], x[k][1]) - max(s[0], x[k][0])) * max(0, min(s[3], y[m][1]) - max(s[1], y[m][0])) for (k, m), had in old.items() if had >= load)
                gained[load] = gained.get(load, 0) + (s[2] - s[0]) * (s[3] - s[1]) - held
        over = {k: v for k, v in gained.items() if v > tolerance}
        if not over:
            return to, locks, scale, passes, worst, None
        worst, new = max(worst, *over.values()), set()
        for (i, j), load in old.items():
            if load in over:
                for a, k, edge, other in (("x", i, x, (i - 1, j)), ("x", i, x, (i + 1, j)), ("y", j, y, (i, j - 1)), ("y", j, y, (i, j + 1))):
                    low = other < (i, j)
                    if cells.get(other, 0) != load:
                        c = edge[k][0 if low else 1]
                        by = to[a][c] - c
                        if (low and by < -1e-9) or (not low and by > 1e-9):
                            new.add((a, next(r["idx"] for r in events[a] if r["coord"] == c), "minus" if low else "plus"))
        if not new:
            return to, locks, scale, passes, worst, "order"
        locks, passes = locks | new, passes + 1


def by_plan(rows):
    out = {}
    for r in rows:
        out.setdefault(r["plan_id"], []).append(r)
    return out


def test_loads_gain_no_ground(spark):
    c = Cover.of(spark, SF)
    events, tables = q._events(spark, SF).collect(), [by_plan(t.collect()) for t in (c.loads, c.x, c.y)]
    df = spark.createDataFrame(events)
    lines = grids.quantised_plans(df, c.loads, c.x, c.y, q.BUDGET).collect()
    rows, summed = by_plan(lines), {r["plan_id"]: r for r in grids.plans(spark.createDataFrame(lines, "plan_id long, axis string, idx long, coord long, w_minus double, w_plus double, tol_minus double, tol_plus double, locked_minus boolean, locked_plus boolean, scale double, passes int, worst double, stretch long, line double, cost double, cells long, problem string")).collect()}
    free = by_plan(grids.quantised_plans(df, c.loads, c.x, c.y, q.BUDGET, guard=False).collect())
    seen = set()
    for plan, mine in by_plan(events).items():
        ev = {a: sorted((r for r in mine if r["axis"] == a), key=lambda r: r["idx"]) for a in "xy"}
        cells = {(r["ix"], r["iy"]): r["load"] for r in tables[0][plan]}
        x, y = ({r["i"]: (r["lo"], r["hi"]) for r in t[plan]} for t in tables[1:])
        to, locks, scale, passes, worst, problem = plain_guard(ev, cells, x, y, q.BUDGET, 1e-6)
        got, row = rows[plan], summed[plan]
        assert {(r["axis"], r["idx"], d) for r in got for d in ("minus", "plus") if r[f"locked_{d}"]} == locks and row["locked"] == len(locks)
        assert (row["passes"], row["problem"]) == (passes, problem) and row["scale"] == pytest.approx(scale) and row["worst"] == pytest.approx(worst)
        assert {(r["axis"], r["coord"]): r["line"] for r in got} == {(a, r["coord"]): None if to is None else pytest.approx(to[a][r["coord"]]) for a in "xy" for r in ev[a]}
        if not locks:
            assert {(r["axis"], r["idx"]): r["line"] for r in free[plan]} == {(r["axis"], r["idx"]): r["line"] for r in got}
        seen.add((problem, passes > 0))
    assert {(None, False), (None, True)} <= seen and len(rows) == len(by_plan(events)), seen


def test_small_and_empty(spark):
    """A load beside a smaller one, its side cheaper to move outward; a plan with one axis alone; no plan at all."""
    e = "plan_id long, axis string, idx long, coord long, w_minus double, w_plus double, tol_minus double, tol_plus double, plan string"
    side = lambda p, a, cs, t: [(p, a, i, c, 1.0, 9.0, t if 0 < i < len(cs) - 1 else 0.0, t if 0 < i < len(cs) - 1 else 0.0, "other") for i, c in enumerate(cs)]
    events = spark.createDataFrame(side(1, "x", [0, 9, 10, 20], 3.0) + side(1, "y", [0, 10], 0.0) + side(2, "x", [0, 10], 0.0), e)
    edge = lambda cs: spark.createDataFrame([(p, i, a, b, 0) for p in (1,) for i, (a, b) in enumerate(itertools.pairwise(cs))], "plan_id long, i long, lo long, hi long, load int")
    cells = spark.createDataFrame([(1, 0, 0, 10, 1.5), (1, 0, 1, 30, 1.5), (1, 0, 2, 20, 1.5)], "plan_id long, iy long, ix long, load long, line double")
    got = {r["plan_id"]: r for r in grids.plans(grids.quantised_plans(events, cells, edge([0, 9, 10, 20]), edge([0, 10]), Budget(most_cells=2))).collect()}
    assert got[2]["problem"] == "budget" and got[2]["cells_x"] is None
    assert got[1]["problem"] is None and (got[1]["cells_x"], got[1]["cells_y"]) == (2, 1) and got[1]["passes"] <= 2
    none = grids.plans(grids.quantised_plans(events.where("false"), cells.where("false"), edge([0, 1]).where("false"), edge([0, 1]).where("false"), Budget()))
    assert none.count() == 0


def test_plans_do_not_wait_for_each_other(spark):
    """All passes of a plan are made in its own group: building the query runs no job, however many passes plans take."""
    c = Cover.of(spark, SF)
    events, cells, x, y = q._events(spark, SF), c.loads, c.x, c.y
    spark.sparkContext.setJobGroup("grids", "building a query")
    try:
        grids.quantised_plans(events, cells, x, y, q.BUDGET)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("grids") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_looked_up_and_scaled():
    rnd = random.Random(6)
    for _ in range(60):
        axis, scale = some_axis(rnd, rnd.randint(2, 8)), rnd.choice([1.0, 1.7, 4.0])
        assert least_lines(axis, scale) == least_lines(stretched(axis, scale))
        begins = np.array(sorted({0, *rnd.sample(range(axis.n), rnd.randint(1, axis.n))}))
        width = rnd.choice([None, 1.0])
        one, two = widened(axis, begins, width), widened(axis, begins, width, axis.table())
        assert (one is None) == (two is None)
        assert one is None or np.isinf(one.cost) or (one.cost == two.cost and (one.place == two.place).all())


def test_violations_by_spans_and_by_cells(spark):
    """What a query tells by spans of each axis is what pairs of cells tell."""
    c, cells = q._snapped(spark, SF)
    want = {(r.plan_id, r.load): r.outside for r in quantise.order_violations(cells, c.loads, c.x, c.y, 1e-6).collect()}
    got = q.q21_order_violations(spark, SF)
    assert {(r.plan_id, r.load): r.outside for r in got.collect()} == {k: pytest.approx(v, abs=0.01) for k, v in want.items()} and want
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "python" not in plan.lower()  # lines are a table


def kinds(plan):
    """The names of a physical plan's nodes; what Spark keeps is a leaf."""
    children = plan.children()
    return [plan.nodeName(), *(k for n in range(children.size()) for k in kinds(children.apply(n)))]


@pytest.mark.parametrize("name", ["q21_order_violations", "q22_locked_lines", "q23_quantised", "q15_snapped"])
def test_no_table_goes_to_the_driver(spark, name):
    """Tables that look small, as the files or the cache of large ones do, are not broadcast."""
    met = kinds(getattr(q, name)(spark, SF)._jdf.queryExecution().sparkPlan())
    assert any("Join" in k for k in met) and not [k for k in met if "Broadcast" in k]


def test_an_axis_is_cut_again_only_where_more_is_forbidden(monkeypatch):
    """A load that gained ground in x forbids moves there; y, where nothing is forbidden, is cut once."""
    line = lambda coord, plus, low, high: Axis(np.array(coord, float), np.ones(len(coord)), np.array(plus, float), np.array(low, float), np.array(high, float))
    axes = [line([0, 9, 10, 20], [1, 1, 9, 1], [0, 3, 3, 0], [0, 3, 3, 0]), line([0, 10], [1, 1], [0, 0], [0, 0])]
    spans = ((np.array([0.0, 9, 10]), np.array([9.0, 10, 20])), (np.array([0.0]), np.array([10.0])))
    none = (np.array([], int), np.array([]), np.array([], bool))
    sides = (np.array([0, 1, 1, 2, 2, 3]), np.array([30.0, 30, 10, 10, 20, 20]), np.array([True, False, True, False, True, False]))
    cut = []
    real = Axis.table
    monkeypatch.setattr(Axis, "table", lambda self: cut.append(self.n) or real(self))
    got = guarded(axes, Budget(most_cells=2), Map(np.array([[30.0], [10.0], [20.0]]), spans, (sides, none)), 1e-6)
    assert (got.passes, got.problem) == (2, "budget") and cut.count(4) == 2 and cut.count(2) == 1


def test_plans_stay_where_they_are_dealt(spark):
    """Boxes are dealt by plan once: what is made of them meets in a plan's group without moving."""
    met = kinds(q.q22_locked_lines(spark, SF)._jdf.queryExecution().executedPlan().initialPlan())
    assert "MapInPandas" in met and not [k for k in met if "Exchange" in k]
