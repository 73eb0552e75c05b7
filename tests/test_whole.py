"""Queries whose SQL states less than the whole job, on small fixtures: SQL where it holds, brute force beyond it."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, plain

from gridloom.operators import layout, mosaic, quantise
from gridloom.plans import catalog
from gridloom.plans import fixtures as fx
from gridloom.plans.cover import Cover

BOXES6 = ("p03_incidence", "p08_dominance", "p08_row_capacity", "x02_best_n2", "p11_verify", "p12_extend", "p13_materialize", "x01_solve_n2", "x01_solve_n3", "m01_boundary_support", "m01_mosaic")


def fixture(spark, path, count, shift=0):
    """The first parts of the smallest tables, under keys that are higher by shift."""
    parts = spark.read.parquet(f"{SF}/part.parquet").where(f"p_partkey < {count}")
    parts.selectExpr(f"p_partkey + {shift} as p_partkey", *(c for c in parts.columns if c != "p_partkey")).write.parquet(f"{path}/part.parquet")
    return str(path)


def told(spark, name, sf, **shift):
    """The sorted rows of a query, as text."""
    df = catalog.queries()[name](spark, sf)
    rows = sorted([plain(r[c] - shift.get(c, 0)) if c in shift else plain(r[c]) for c in sorted(df.columns)] for r in df.collect())
    spark.catalog.clearCache()
    return rows


def asked(sql, sf):
    """The sorted rows of a SQL text, as text."""
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf}/part.parquet{'/*.parquet' if sf != SF else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in got.fetchall())


@pytest.fixture(autouse=True)
def small(spark):
    """Plans of few rows run faster without generated code and in one partition."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", BOXES6)
def test_plans_after_the_hundredth(spark, tmp_path, name):
    """Keys higher by 600 give the same boxes in plans higher by 100, so the SQL of the first plans tells the later ones."""
    rows = told(spark, name, fixture(spark, tmp_path / "high", 24, 600), plan_id=100)
    assert rows
    if name in catalog.part_sql() and not name.startswith("m01"):
        assert rows == asked(catalog.part_sql()[name], fixture(spark, tmp_path / "low", 24))


def test_order_of_every_request(spark, tmp_path):
    """The SQL tells the first hundred requests; each other one follows from its own numbers."""
    low, high = fixture(spark, tmp_path / "low", 100), fixture(spark, tmp_path / "high", 30, 8000)
    assert told(spark, "t22_order", low) == asked(catalog.part_sql()["t22_order"], low)
    rows = told(spark, "t22_order", high, task_id=8000)
    assert rows and rows == asked(catalog.part_sql()["t22_order"], fixture(spark, tmp_path / "few", 30))


def test_mosaic_of_all_candidates(spark, tmp_path):
    """Every candidate's sides count; the SQL tells the same of every fifth candidate."""
    sf = fixture(spark, tmp_path, 12)
    c = Cover.of(spark, sf, fx.ALL6)
    cands, cells = c.candidates.collect(), {(r["plan_id"], r["iy"], r["ix"]): r["cls"] for r in c.cells.where("cls > 0").collect()}
    support = Counter()
    for r in cands:
        support.update((r["plan_id"], "x", y, x) for y in range(r["y0"], r["y1"] + 1) for x in (r["x0"] - 1, r["x1"]))
        support.update((r["plan_id"], "y", y, x) for x in range(r["x0"], r["x1"] + 1) for y in (r["y0"] - 1, r["y1"]))
    label = {k: k for k in cells}
    for _ in cells:
        for p, y, x in cells:
            for side, to in (("x", (p, y, x + 1)), ("y", (p, y + 1, x))):
                if cells.get(to) == cells[p, y, x] and not support[p, side, y, x]:
                    label[p, y, x] = label[to] = min(label[p, y, x], label[to])
    fifth = c.candidates.where("cand_id % 5 = 0").select("plan_id", "x0", "y0", "x1", "y1")
    df = mosaic.boundary_support(fifth)
    assert sorted([plain(r[k]) for k in sorted(df.columns)] for r in df.collect()) == asked(catalog.part_sql()["m01_boundary_support"], sf)
    got = {(r["plan_id"], r["side"], r["iy"], r["ix"]): r["support"] for r in catalog.queries()["m01_boundary_support"](spark, sf).collect()}
    assert got == dict(support)
    got = {(r["plan_id"], r["iy"], r["ix"]): r["label"] for r in catalog.queries()["m01_mosaic"](spark, sf).collect()}
    assert got == {k: y * (1 << 20) + x for k, (_, y, x) in label.items()}


def test_snapping_that_moves_nothing_breaks_no_order(spark, tmp_path):
    """Where an axis has no more lines than asked for, cells stay; snapped to fewer, they fill what they say."""
    c = Cover.of(spark, fixture(spark, tmp_path, 36))
    events = quantise.axis_events(c.loads, c.x, c.y, "x", 0.2).unionByName(quantise.axis_events(c.loads, c.y, c.x, "y", 0.2))
    x, y = ({(r["plan_id"], r["i"]): (r["lo"], r["hi"]) for r in e.collect()} for e in (c.x, c.y))
    want = sorted((r["plan_id"], r["load"], *(float(e[r["plan_id"], r[i]][k]) for k in (0, 1) for e, i in ((x, "ix"), (y, "iy")))) for r in c.loads.where("load > 0").collect())
    still = quantise.snapped(c.loads, c.x, c.y, quantise.quantised(events, 100))
    squares = lambda rows: sorted((p, load, i, j) for p, load, x0, y0, x1, y1 in rows for i in range(int(x0), int(x1), 500) for j in range(int(y0), int(y1), 500))
    assert squares(map(tuple, still.collect())) == squares(want)  # a line at which no load changes bounds nothing
    assert not quantise.order_violations(still, c.loads, c.x, c.y, 1e-6).collect()
    moved = quantise.snapped(c.loads, c.x, c.y, quantise.quantised(events, 6).where("problem is null"))
    had = {}
    for p, load, x0, y0, x1, y1 in map(tuple, moved.collect()):
        held = sum(max(0, min(x1, b[4]) - max(x0, b[2])) * max(0, min(y1, b[5]) - max(y0, b[3])) for b in want if b[0] == p and b[1] >= load)
        had[p, load] = had.get((p, load), 0) + (x1 - x0) * (y1 - y0) - held
    got = {(r["plan_id"], r["load"]): round(r["outside"], 3) for r in quantise.order_violations(moved, c.loads, c.x, c.y, 1e-6).collect()}
    assert got == {k: round(v, 3) for k, v in had.items() if v > 1e-6}


def test_frontier_of_thirteen_lines(spark):
    """Thirteen lines out of each other's reach have one partition, of thirteen stretches."""
    events = spark.range(13).selectExpr("1L as plan_id", "'y' as axis", "id as idx", "id * 1000 as coord", "5L as w_minus", "5L as w_plus", "400L as tol_minus", "400L as tol_plus")
    got = quantise.exact_partitions(events).collect()
    assert [tuple(r) for r in got] == [(1, "y", 13, 0)]


def test_triples_at_one_place(spark):
    """Three bars at one place are told where all run; two of them, or three that never run together, are not."""
    rows = [(1, z, 0, x, y0, x + w, y1, 100) for z, x, y0, y1, w in [(1, 100, 0, 50, 30), (2, 100, 20, 90, 30), (3, 100, 40, 70, 30), (4, 100, 60, 80, 30), (5, 200, 0, 9, 30), (6, 200, 0, 9, 30), (7, 120, 0, 90, 80)]]
    zones = spark.createDataFrame(rows, "plan_id long, zone_id long, cls int, x0 long, y0 long, x1 long, y1 long, step long")
    assert sorted(map(tuple, layout.coincident_triples(zones).collect())) == [(1, 1, 2, 3, 100, 40, 50), (1, 2, 3, 4, 100, 60, 70)]


def test_bars_are_rounded_to_the_nearest_step(spark):
    """A zone of 1000 at step 150 has eight bars, the last of them outside; halves go to the even number."""
    rows = [(1, 1, 0, 0, 0, 1000, 9, 150), (1, 2, 0, 0, 0, 250, 9, 100), (1, 3, 0, 0, 0, 350, 9, 100)]
    zones = spark.createDataFrame(rows, "plan_id long, zone_id long, cls int, x0 long, y0 long, x1 long, y1 long, step long")
    assert {r.zone_id: r["count"] for r in layout.positions(zones).groupBy("zone_id").count().collect()} == {1: 8, 2: 3, 3: 5}


def test_least_lines_are_those_of_the_exact_partition(spark):
    """Neighbours only share a line: lines at -5 and 5 that stay are not joined past those between them."""
    coords = [(-5, 0, 0), (0, 0, 10), (1, 11, 0), (5, 0, 0)]
    rows = [(1, "x", k, c, 1, 1, lo, hi) for k, (c, lo, hi) in enumerate(coords)]
    rnd = random.Random(5)
    for plan in range(2, 60):
        for axis in "xy":
            rows += [(plan, axis, k, c, rnd.randint(0, 5), rnd.randint(0, 5), rnd.randint(0, 40), rnd.randint(0, 40)) for k, c in enumerate(sorted(rnd.sample(range(150), rnd.randint(1, 9))))]
    events = spark.createDataFrame(rows, "plan_id long, axis string, idx long, coord long, w_minus long, w_plus long, tol_minus long, tol_plus long")
    least = {(r.plan_id, r.axis): r.k for r in quantise.exact_partitions(events).groupBy("plan_id", "axis").agg(F.min("k").alias("k")).collect()}
    got = {(r.plan_id, r.axis): r.lines for r in quantise.minimum_lines(events).collect()}
    assert got == least and got[1, "x"] == 3


def test_lines_that_must_stay_apart(spark):
    """Pairs of lines limit stretches, merges and the least number of lines alike: none of them holds both ends of a pair."""
    rnd, rows, apart = random.Random(6), [], []
    for plan in range(60):
        coords = sorted(rnd.sample(range(150), rnd.randint(2, 9)))
        rows += [(plan, "x", k, c, rnd.randint(0, 5), rnd.randint(0, 5), rnd.randint(0, 90), rnd.randint(0, 90)) for k, c in enumerate(coords)]
        apart += [(plan, "x", *rnd.sample(coords, 2)) for _ in range(rnd.randint(0, 3))] + [(plan, "x", coords[0], 999)]
    events = spark.createDataFrame(rows, "plan_id long, axis string, idx long, coord long, w_minus long, w_plus long, tol_minus long, tol_plus long")
    limited = quantise.stretch_limits(events, spark.createDataFrame(apart, "plan_id long, axis string, low long, high long"))
    at = {(r[0], r[3]): r[2] for r in rows}
    pairs = [(p, at[p, a], at[p, b]) for p, _, a, b in apart if (p, b) in at and a < b]
    assert {(r.plan_id, r.idx): r.limit for r in limited.collect()} == {(r[0], r[2]): min((b - 1 for p, a, b in pairs if p == r[0] and a >= r[2]), default=None) for r in rows}
    least = {r.plan_id: r.k for r in quantise.exact_partitions(limited).groupBy("plan_id").agg(F.min("k").alias("k")).collect()}
    assert {r.plan_id: r.lines for r in quantise.minimum_lines(limited).collect()} == least
    for greedy in (False, True):
        of = {(r.plan_id, r.idx): r.stretch for r in quantise.quantised(limited, 3, greedy).where("problem is null").collect()}
        assert of and all(of[p, a] != of[p, b] for p, a, b in pairs if (p, a) in of)
    assert least != {r.plan_id: r.k for r in quantise.exact_partitions(events).groupBy("plan_id").agg(F.min("k").alias("k")).collect()}
