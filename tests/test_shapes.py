"""Areas of random rings against exact fractions, strip by strip from the left, and rings at their edges."""

import random
from fractions import Fraction

from gridloom.operators import rings, shapes
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"


def area(shapes_of):
    """The area that any shape of a list of lists of rings holds, exactly."""
    edges = [(k, *sorted((r[i - 1], r[i]))) for k, rings in enumerate(shapes_of) for r in rings for i in range(len(r)) if r[i - 1][0] != r[i][0]]
    xs = {Fraction(p[0]) for _, a, b in edges for p in (a, b)}
    for _, a, b in edges:
        for _, c, d in edges:
            turn = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if turn:
                t = Fraction((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), turn)
                xs.add(a[0] + t * (b[0] - a[0]))
    xs, total = sorted(xs), Fraction(0)
    for lo, hi in zip(xs, xs[1:], strict=False):
        mid, met = (lo + hi) / 2, []
        for k, a, b in edges:
            if a[0] <= lo and b[0] >= hi:
                met.append((a[1] + (mid - a[0]) * Fraction(b[1] - a[1], b[0] - a[0]), k))
        inside, last = set(), None
        for y, k in sorted(met):
            if inside:
                total += (y - last) * (hi - lo)
            inside ^= {k}
            last = y
    return total


def test_random_rings(spark):
    rng, rows, want = random.Random(3), [], {}
    for key in range(60):
        many = [[[(rng.randint(0, 7), rng.randint(0, 7)) for _ in range(rng.randint(3, 7))] for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 3))]
        many = [[r for r in rings if len(set(r)) >= 3 and all(r[i] != r[i - 1] for i in range(len(r)))] for rings in many]
        rows += [(key, k, [(float(x), float(y)) for x, y in r], "clash") for k, rings in enumerate(many) for r in rings]
        want[key] = float(area(many))
    rings = spark.createDataFrame(rows, f"key long, shape int, points {POINTS}, y0 string")
    got = {r.key: r.area for r in shapes.measured(shapes.united(rings, ["key"]), ["key"]).collect()}
    assert len(got) > 50
    for key, a in want.items():
        assert abs(got.get(key, 0.0) - a) < 1e-6, key


def test_nested_and_touching(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    rows = [(1, 0, box(0.0, 0.0, 4.0, 4.0)), (1, 0, box(1.0, 1.0, 2.0, 2.0)), (2, 0, box(0.0, 0.0, 1.0, 1.0)), (2, 1, box(1.0, 0.0, 2.0, 1.0)), (3, 0, box(0.0, 0.0, 1.0, 1.0)), (3, 1, box(0.0, 0.0, 1.0, 1.0))]
    got = shapes.united(spark.createDataFrame(rows, f"key long, shape int, points {POINTS}"), ["key"])
    assert {r.key: r.area for r in shapes.measured(got, ["key"]).collect()} == {1: 15.0, 2: 2.0, 3: 1.0}
    assert got.where("key = 2").count() == 1  # boxes that touch are one stretch


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [(0.0, 0.0), (1.0, 1.0)]), (4, [(0.0, 0.0), (1.0, None), (1.0, 1.0), (2.0, 0.0)]), (5, [(0.0, 0.0), (nan, 0.0), (1.0, 1.0)]), (6, [(0.0, 0.0), (inf, 0.0), (1.0, 1.0)]), (7, [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)])]
    rings = spark.createDataFrame(rows, f"poly_id long, points {POINTS}")
    assert [(r.poly_id, len(r.ring)) for r in rings.select("poly_id", shapes.clean_ring(F.col("points")).alias("ring")).where("ring is not null").collect()] == [(7, 3)]
    plans = rings.select(F.lit(1).alias("plan_id"), "poly_id", F.lit(5).alias("load"), "points")
    assert [tuple(r) for r in shapes.boxes(plans).collect()] == [(1, 7, 0.0, 0.0, 2.0, 2.0, 5)]
    assert shapes.boxes(plans.limit(0)).count() == 0
    whole = rings.select("poly_id", F.array("points", "points").alias("rings"))
    assert [(r.poly_id, len(r.rings)) for r in shapes.clean_polygons(whole).collect()] == [(7, 2)]


def test_rings_are_worked_out_once():
    """An expression named again in a lambda is worked out again there; clean polygons took so long that a table did not end."""
    for f in (shapes.clean_ring, rings.without_axis_points, rings.without_straight_points, lambda c: rings.without_straight_points(rings.without_axis_points(shapes.clean_ring(c)))):
        assert str(f(F.col("points"))).count("points") == 1


def test_odd_rings_and_polygons(spark):
    nan = float("nan")
    box, line = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    given = [(1, [box + box[:1], [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0)]]), (2, [line, box]), (3, [box, line, None]), (4, [None, box]), (5, []), (6, None), (7, [[(0.0, nan), *box], box]), (8, [[(0.0, None), *box]]), (9, [[]]), (10, [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], box])]
    got = shapes.clean_polygons(spark.createDataFrame(given, "poly_id long, rings array<array<struct<x: double, y: double>>>"))
    assert {r.poly_id: [[tuple(p) for p in ring] for ring in r.rings] for r in got.collect()} == {1: [box, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]], 3: [box]}
