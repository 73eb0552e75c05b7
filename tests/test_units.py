"""Units of mosaics against a plain flood over random cells, labels and rectangles, and their edges."""

import random

from gridloom.operators import model, mosaic

CELLS = "plan_id long, iy int, ix int, label long, profile long, root string"
RECTS = "plan_id long, rect_id long, x0 int, y0 int, x1 int, y1 int"


def flooded(cells, rects):
    """plan -> {(iy, ix): (unit, first cell)}, by walking from cell to cell."""
    out = {}
    for plan in {c[0] for c in cells}:
        mine = {(c[1], c[2]): (c[3], c[4]) for c in cells if c[0] == plan}
        held = {at: frozenset(r[1] for r in rects if r[0] == plan and r[2] <= at[1] <= r[4] and r[3] <= at[0] <= r[5]) for at in mine}
        seen, unit = {}, 0
        for start in sorted(mine):
            if start in seen:
                continue
            seen[start], todo = (unit, start), [start]
            while todo:
                y, x = todo.pop()
                for to in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                    if to in mine and to not in seen and mine[to] == mine[y, x] and not separated(rects, plan, (y, x), to):
                        seen[to] = (unit, start)
                        todo.append(to)
            unit += 1
        for at, (u, _) in seen.items():  # no rectangle holds a part of a unit only
            assert all(held[at] == held[other] for other, (v, _) in seen.items() if v == u)
        out[plan] = seen
    return out


def separated(rects, plan, a, b):
    inside = lambda r, at: r[2] <= at[1] <= r[4] and r[3] <= at[0] <= r[5]
    return any(r[0] == plan and inside(r, a) != inside(r, b) for r in rects)


def test_random_plans(spark):
    rng = random.Random(7)
    cells, rects = [], []
    for plan in range(25):
        ny, nx = rng.randint(1, 9), rng.randint(1, 9)
        cells += [(plan, y, x, rng.choice((1, 1, 1, None)), 1 + (x > 5), "clash") for y in range(ny) for x in range(nx) if rng.random() < 0.85]
        for k in range(rng.randint(0, 4)):
            x0, y0 = rng.randint(0, nx - 1), rng.randint(0, ny - 1)
            rects.append((plan, k, x0, y0, rng.randint(x0, nx - 1), rng.randint(y0, ny - 1)))
    want = flooded(cells, rects)
    got = mosaic.refined(spark.createDataFrame(cells + cells[:40], CELLS), spark.createDataFrame(rects + rects[:5], RECTS))
    units = {(r.plan_id, r.iy, r.ix): r.unit for r in got.collect()}
    assert units == {(p, *at): u for p, seen in want.items() for at, (u, _) in seen.items()}
    first = {(r.plan_id, r.unit): (r.iy, r.ix, r.size) for r in mosaic.unit_rows(got).collect()}
    for p, seen in want.items():
        for u, start in set(seen.values()):
            assert first[p, u] == (*start, sum(v == u for v, _ in seen.values()))
    cut = mosaic.units_inside(got, spark.createDataFrame(rects, RECTS))
    assert cut.where("cut").count() == 0 and cut.count() > 0


def test_a_long_snake_is_one_unit(spark):
    cells = [(1, y, x, 1, 1, "") for y in range(0, 41) for x in range(40) if y % 2 == 0 or x == (39 if y % 4 == 1 else 0)]
    none = spark.createDataFrame([], RECTS)
    got = mosaic.unit_rows(mosaic.refined(spark.createDataFrame(cells, CELLS), none)).collect()
    assert [(r.iy, r.ix, r.size) for r in got] == [(0, 0, len(cells))]
    assert mosaic.refined(spark.createDataFrame([], CELLS), none).count() == 0


def test_subset_numbers_candidates_anew(spark):
    covers = spark.createDataFrame([(1, 4, 0, 1), (1, 4, 2, 1), (1, 9, 2, 1), (2, 4, 0, 1)], "plan_id long, cand_id long, row_id long, need long")
    chosen = spark.createDataFrame([(1, 9), (1, 9), (1, 6), (3, 1)], "plan_id long, cand_id long")
    assert [tuple(r) for r in model.subset(covers, chosen).collect()] == [(1, 1, 9, 2)]
    assert sorted((r.plan_id, r.row_id, r.cand_ids) for r in model.row_candidates(covers).collect()) == [(1, 0, [4]), (1, 2, [4, 9]), (2, 0, [4])]
