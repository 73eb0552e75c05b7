"""Edges of the operators on result rows, checks, mosaics, fields and made grids."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.operators import layout, model, mosaic, raster, results, rings


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_label_problems(spark):
    shapes = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 0, 0)], "plan_id long, ny int, nx int")
    labels = spark.createDataFrame(
        [(1, 0, 0, 1.0), (1, 0, 0, 1.0), (2, 0, 0, None), (3, 0, 0, 0.5), (4, 0, 1, 1.0), (5, 0, 0, float("nan")), (9, 0, 0, 1.0)], "plan_id long, iy int, ix int, label double"
    )
    got = dict(rows(mosaic.label_problem(labels, shapes).na.fill("")))
    assert got == {1: "shape", 2: "finite", 3: "integer", 4: "shape", 5: "finite", 6: ""}
    assert set(dict(rows(mosaic.label_problem(labels.limit(0), shapes).na.fill(""))).values()) == {"shape", ""}


def test_units_inside(spark):
    units = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 0, 7), (1, 0, 1, 7), (1, 1, 0, 8), (1, 1, 1, -1), (1, 2, 2, None)], "plan_id long, iy int, ix int, unit long")
    rects = spark.createDataFrame([(1, 1, 0, 0, 0, 1), (1, 2, 0, 0, 2, 2)], "plan_id long, rect_id long, x0 int, y0 int, x1 int, y1 int")
    assert rows(mosaic.units_inside(units, rects)) == [(1, 1, 7, True), (1, 1, 8, False), (1, 2, 7, False), (1, 2, 8, False)]
    assert not rows(mosaic.units_inside(units.limit(0), rects))


def test_checked_counts(spark):
    rows_ = spark.createDataFrame([(p, 0, 2) for p in range(1, 7)], "plan_id long, row_id long, need int")
    covers = spark.createDataFrame([(p, 0, 0, 2) for p in range(1, 7)], "plan_id long, cand_id long, row_id long, need int")
    bounds = spark.createDataFrame([(p, 0, 2) for p in range(1, 7)], "plan_id long, cand_id long, ub int")
    chosen = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 0, 3), (3, 0, 1), (4, 5, 2), (5, 0, -1)], "plan_id long, cand_id long, copies long")
    asked = spark.createDataFrame([(1, 2), (2, None), (3, 1), (4, 2), (5, 2), (6, 0), (7, 0)], "plan_id long, n long")
    got = {r.plan_id: (r.in_bounds, r.right_count, r.supplied, r.ok) for r in model.checked_counts(rows_, covers, bounds, chosen, asked).collect()}
    assert got == {1: (True, True, True, True), 2: (False, True, True, False), 3: (True, True, False, False), 4: (False, True, False, False), 5: (False, False, False, False), 6: (True, True, False, False), 7: (True, True, True, True)}


def test_result_rows(spark):
    left_out = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, "x")], "job_id long, is_feasible boolean, is_optimal boolean, infeasibility_proved boolean, cache_hit boolean, termination_reason string, time_limit_reached boolean, has_incumbent boolean, incumbent_source string, incumbent_is_solver_best boolean, other string")
    r = results.with_defaults(left_out).first()
    assert (r.termination_reason, r.time_limit_reached, r.has_incumbent, r.incumbent_source, r.incumbent_is_solver_best, r.other) == ("no_solution", False, False, None, False, "x")
    assert not rows(results.with_defaults(left_out.limit(0)))
    asked = spark.createDataFrame([(None, None, None), (1, 2, "")], "plan_id long, n long, reason string")
    assert [(r.n_requested, r.reason, r.status) for r in results.known_infeasible(asked).orderBy("plan_id").collect()] == [(None, "proved infeasible before", "Infeasible"), (2, "proved infeasible before", "Infeasible")]


def test_inside_field(spark):
    field = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0)], "plan_id long, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([(1, 1, 0.5, 0.0, 1.5, 1.0), (1, 2, 0.5, 0.0, 2.0 + 5e-8, 1.0), (1, 3, 0.5, 0.0, 2.1, 1.0), (2, 4, 0.0, 0.0, 1.0, 1.0)], "plan_id long, zone_id long, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.inside_field(zones, field)) == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 4, False)]
    assert not rows(layout.inside_field(zones.limit(0), field))


def test_random_grids(spark):
    schema = "plan_id long, m int, share double, low double, high double, seed long"
    grids = spark.createDataFrame([(1, 5, 0.0, 1.0, 2.0, 3), (2, 4, 1.0, 1.0, 1.0, 3), (3, 60, 0.3, 0.5, 2.0, None)], schema)
    ones = dict(rows(raster.random_mask(grids).groupBy("plan_id").agg(F.sum("one"))))
    assert ones[1] == 1 and ones[2] == 16 and 900 < ones[3] < 1260
    assert rows(raster.random_mask(grids)) == rows(raster.random_mask(grids.repartition(3)))
    assert all(0.5 <= r.size <= 2 for r in raster.random_sizes(grids).collect())
    for bad in [(1, 0, 0.5, 1.0, 2.0, 1), (1, 2, 1.5, 1.0, 2.0, 1), (1, 2, 0.5, 3.0, 2.0, 1), (1, None, 0.5, 1.0, 2.0, 1)]:
        with pytest.raises(Exception, match="no such grid"):
            raster.random_mask(spark.createDataFrame([bad], schema)).collect()


def test_flat_polygons(spark):
    deep = '{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection"},{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[2,2],[3,2],[3,3]]]}]}'
    got = rings.flat_polygons(spark.createDataFrame([(1, None), (2, ""), (3, deep), (4, "null")], "poly_id long, geometry string"))
    assert [(r.poly_id, r.pos, len(r.rings)) for r in got.collect()] == [(3, 0, 2)]


def test_random_mask_of_one_row_alone(spark):
    grids = spark.range(40).selectExpr("id as plan_id", "cast(1 + id % 5 as int) as m", "cast(id % 3 as double) / 10 as share", "0.5D as low", "2.0D as high", "id * 31 as seed")
    mask = raster.random_mask(grids)
    plan = mask._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    chance = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16) / 2**32
    want = []
    for g in grids.collect():
        ones = {(y, x): int(chance(g.seed, y, x) < g.share) for y in range(g.m) for x in range(g.m)}
        if not any(ones.values()):
            ones[int(chance(g.seed, "row") * g.m), int(chance(g.seed, "column") * g.m)] = 1
        want += [(g.plan_id, y, x, one) for (y, x), one in ones.items()]
    assert rows(mask) == sorted(want)
