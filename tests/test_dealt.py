"""The chain from boxes to priced candidates stays with its plan, and what it gives does not depend on how boxes are dealt."""

from __future__ import annotations

import pytest

from gridloom.operators import model, mosaic
from gridloom.plans import catalog, cover
from gridloom.plans import fixtures as fx
from gridloom.plans.cover import Cover
from gridloom.session import spread

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["valued", "listed"])
def test_candidates_do_not_move(spark, name):
    """Candidates are made where their plan's cells are: no exchange holds them, whatever Spark takes for small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(Cover.of(spark, SF), name)._jdf.queryExecution().executedPlan().toString()
        own = plan.splitlines()
        moved = [line for line in own if "Exchange hashpartitioning" in line and ("x0#" in line or "x1#" in line)]
        assert "Exchange" in plan and not moved
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_more_tasks_for_more_boxes(spark, monkeypatch):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(100), "id", each=10**6).rdd.getNumPartitions() == tasks
    assert spread(spark.range(100 * tasks), "id", each=7).rdd.getNumPartitions() == -(-100 * tasks // 7)
    few = sorted(map(tuple, catalog.queries()["p01_metrics"](spark, SF).collect()))
    monkeypatch.setattr(cover, "EACH", 9)
    assert few and few == sorted(map(tuple, catalog.queries()["p01_metrics"](spark, SF).collect()))


def test_single_zone_by_hull_and_by_rows(spark):
    """The hull of a plan's rows tells the same as counting the rows that each candidate covers."""
    c = Cover.of(spark, SF, fx._boxes(2, 4, 3, 500))
    need, held = {}, {}
    for r in c.rows.collect():
        need.setdefault(r.plan_id, {})[r.row_id] = r.need
    for r in model.incidence(c.listed, c.rows).collect():
        held.setdefault((r.plan_id, r.cand_id), set()).add(r.row_id)
    cost = {(r.plan_id, r.cand_id): r.cost for r in c.valued.collect()}
    want = {}
    for p, rows in need.items():
        full = [(cost[k], k[1]) for k, v in held.items() if k[0] == p and len(v) == len(rows) and set(rows.values()) == {1}]
        want[p] = (len(rows), bool(full), *(min(full)[::-1] if full else (None, None)))
    got = {r.plan_id: (r.n_rows, r.feasible, r.cand_id, r.cost) for r in model.best_single(c.valued, c.rows).collect()}
    assert got == want and any(f for _, f, *_ in want.values())


def test_repeated_rectangles_separate_as_one(spark):
    cells = spark.createDataFrame([(1, y, x, 0, 1) for y in range(3) for x in range(3)], "plan_id long, iy long, ix long, label long, profile int")
    rects = [(1, 0, 0, 0, 2), (1, 1, 0, 2, 2)]
    once, twice = (sorted(map(tuple, mosaic.refined(cells, spark.createDataFrame(r, "plan_id long, x0 long, y0 long, x1 long, y1 long")).collect())) for r in (rects, rects * 3))
    assert once == twice and len({r[5] for r in once}) == 2


def test_requests_are_dealt_before_their_numbers(spark):
    """One exchange, of requests, below the place where numbers are made."""
    plan = catalog.queries()["t22_order"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
