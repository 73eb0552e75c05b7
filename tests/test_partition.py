"""Masks cut into rectangles against every choice of rectangles."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.kernels import partition as kernel
from gridloom.operators import partition
from gridloom.plans import partition_queries


def every(ones, x, y, least, physical, zeros):
    """Least cost for each number, by every set of disjoint rectangles."""
    ny, nx = ones.shape
    some = []
    for x0, x1 in itertools.combinations(range(nx + 1), 2):
        for y0, y1 in itertools.combinations(range(ny + 1), 2):
            part = ones[y0:y1, x0:x1]
            if sum(x[x0:x1]) >= least[0] and sum(y[y0:y1]) >= least[1] and part.any() and (zeros or part.all()):
                some.append(({(i, j) for i in range(y0, y1) for j in range(x0, x1)}, sum(x[x0:x1]) * sum(y[y0:y1]) if physical else part.size))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(ones), strict=True)}
    best = {}

    def walk(at, used, n, cost):
        if want <= used:
            best[n] = min(best.get(n, cost), cost)
        for k in range(at, len(some)):
            if not some[k][0] & used:
                walk(k + 1, used | some[k][0], n + 1, cost + some[k][1])

    walk(0, set(), 0, 0)
    return best


def test_frontier_against_every_choice():
    rnd = random.Random(1)
    for _ in range(120):
        ny, nx = rnd.choice([(1, 4), (2, 3), (3, 3), (2, 2), (3, 2)])
        ones = np.array([[rnd.random() < 0.6 for _ in range(nx)] for _ in range(ny)])
        x, y = [rnd.randint(1, 3) for _ in range(nx)], [rnd.randint(1, 3) for _ in range(ny)]
        how = (rnd.choice([(0, 0), (2, 0), (0, 2)]), rnd.random() < 0.5, rnd.random() < 0.7)
        some = kernel.rectangles(ones, np.array(x, float), np.array(y, float), *how)
        got = kernel.frontier(ones, some)
        assert {n: v[0] for n, v in got.items()} == every(ones, x, y, *how)
        for n, (cost, chosen) in got.items():
            assert len(chosen) == n and sum(some[i][1] for i in chosen) == cost
            assert all(not some[a][0] & some[b][0] for a, b in itertools.combinations(chosen, 2))


def tables(spark, masks, sizes=None):
    cells = [(p, i, j, int(v)) for p, m in masks.items() for i, r in enumerate(m) for j, v in enumerate(r)]
    lines = [(p, a, i, 1.0) for p, m in masks.items() for a, n in (("x", len(m[0])), ("y", len(m))) for i in range(n)]
    return spark.createDataFrame(cells, "plan_id long, iy int, ix int, one int"), spark.createDataFrame(sizes or lines, "plan_id long, axis string, i int, size double")


def test_sweeps(spark):
    """A ring of eight cells needs four rectangles to be held alone; one holds it with its hole."""
    cells, sizes = tables(spark, {1: [[1, 1, 1], [1, 0, 1], [1, 1, 1]], 2: [[0, 0]], 3: [[1]]})
    parts = partition.partitions(cells, sizes)
    area = {(r.plan_id, r.n): r.area for r in parts.collect()}
    assert area[1, 1] == 9 and area[1, 2] == 9 and area[1, 4] == 8 and area[1, 8] == 8 and (1, 9) not in area
    assert {k: v for k, v in area.items() if k[0] > 1} == {(2, 0): 0, (3, 1): 1}
    asked = spark.createDataFrame([(1, n) for n in (8, 5, 4, 1, 0, 1, -3)] + [(3, 7), (3, 1), (3, 0)], "plan_id long, n long")
    got = {(r.plan_id, r.n): (r.area, r.skipped, r.saturation) for r in partition.swept(parts, asked).collect()}
    assert got == {(1, 0): (None, "infeasible", 4), (1, 1): (9, None, 4), (1, 4): (8, None, 4), (3, 0): (None, "infeasible", 1), (3, 1): (1, None, 1)}
    got = {(r.plan_id, r.n): r.skipped for r in partition.swept(parts, asked, stop=False).collect()}
    assert got[3, 7] == "candidates" and got[1, 5] is None and len(got) == 8
    one = {r.n: (r.is_optimal, r.reached_floor, r.reason) for r in partition.solved(parts, asked.where("plan_id = 1")).collect()}
    assert one[1] == (True, False, "solver") and one[4] == (True, True, "solver_and_theoretical_lower_bound") and one[0] == (False, False, None)
    alone = {r.plan_id: (r.n, r.area) for r in partition.least_number(partition.partitions(cells, sizes, zeros=False)).collect()}
    assert alone == {1: (4, 8), 2: (0, 0), 3: (1, 1)}
    assert {r.plan_id: r.n for r in partition.least_number(parts).collect()} == {1: 1, 2: 0, 3: 1}


def test_problems_and_edges(spark):
    cells, sizes = tables(spark, {1: [[1, 0]], 2: [[1, 1]], 3: [[1]]})
    bad = cells.where("not (plan_id = 2 and ix = 1)").withColumn("size", F.lit("x")).withColumn("kind", F.lit(1))
    got = {r.plan_id: r.problem for r in partition.partitions(bad, sizes, least=(2.0, 0.0), zeros=False).collect()}
    assert got == {1: "uncoverable", 2: "shape", 3: "uncoverable"}
    assert {r.plan_id: r.problem for r in partition.least_number(partition.partitions(bad, sizes)).collect()} == {1: None, 2: "shape", 3: None}
    assert partition.partitions(cells.where("false"), sizes.where("false")).collect() == []
    empty = cells.where("plan_id = 3").withColumn("one", F.lit(None).cast("int"))
    assert [(r.n, r.area) for r in partition.partitions(empty, sizes.where("plan_id = 3")).collect()] == [(0, 0)]


def test_masks_are_solved_once_and_without_loose_rectangles(spark, tmp_path):
    spark.range(60).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = partition_queries.x23_swept(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "Broadcast" not in plan
    assert got.count() > 60
    ones = np.zeros((4, 4), bool)
    ones[1, 1] = ones[2, 3] = True
    some = kernel.rectangles(ones, np.ones(4), np.ones(4), (0.0, 0.0), False, True)
    assert [some[i][2] for i in kernel._tight(ones, some)] == [(1, 1, 2, 2), (1, 1, 4, 3), (3, 2, 4, 3)]
    assert kernel.frontier(ones, some) == {1: (6.0, [k for k, r in enumerate(some) if r[2] == (1, 1, 4, 3)]), 2: (2.0, [k for k, r in enumerate(some) if r[2] in ((1, 1, 2, 2), (3, 2, 4, 3))])}
