"""Searches over plans: many plans at once in a task, and none does again what cannot have changed."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridloom.kernels import cover
from gridloom.kernels.choose import Plan, choose
from gridloom.operators import searches
from gridloom.plans import catalog, fit_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["assigned", "structural", "chosen"])
def test_no_frame_for_each_plan(spark, monkeypatch, name):
    """The search is a function over batches of plans, and a plan's rows of all its tables move to it in one exchange."""
    made = []
    monkeypatch.setattr(fit_queries, "stored", lambda df, label: made.append(df) or df.localCheckpoint())
    getattr(fit_queries.Fit.of(spark, SF), name)
    plan = made[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["x01_solve_n2", "x01_solve_n3"])
def test_covers_without_frames(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 1


def test_the_last_candidate_is_looked_up(monkeypatch):
    """Places for the last candidate are not tried one by one: twelve candidates of which any two cover six rows take few steps."""
    held = np.array([[(r + c) % 2 == 0 for r in range(6)] for c in range(12)])
    steps = []
    real = cover._Part.apart
    monkeypatch.setattr(cover._Part, "apart", lambda self, *a: steps.append(1) or real(self, *a))
    status, cost, zones = cover.solve(held, np.ones(6, int), np.arange(12, 0, -1.0), np.ones(12, int), 2)
    assert (status, cost, zones) == ("optimal", 3.0, [10, 11]) and len(steps) <= 3


def test_rows_of_a_plan_meet_whatever_table_they_are_in(spark, monkeypatch):
    monkeypatch.setattr(searches, "_AT_ONCE", 2)
    rnd = random.Random(4)
    a = [(rnd.randrange(9), rnd.choice([None, k])) for k in range(60)]
    b = [(rnd.randrange(5, 14), float(k), [k, None]) for k in range(40)]
    one = lambda plan, x, y: [(plan, len(x), sum(v or 0 for (v,) in x), sum(v for v, _ in y), [w[0] for _, w in sorted(y)])] * (plan % 3)
    got = searches.by_plan([spark.createDataFrame(a, "plan_id long, v int"), spark.createDataFrame(b, "plan_id long, v double, w array<int>")], one, "plan_id long, n long, a long, b double, w array<long>")
    want = [one(p, [r[1:] for r in a if r[0] == p], [r[1:] for r in b if r[0] == p]) for p in {r[0] for r in a + b}]
    assert sorted(map(tuple, got.collect())) == sorted(r for rows in want for r in rows)


def test_zones_that_nothing_moved_near_are_not_scored_again(monkeypatch):
    """Two zones that run nowhere beside each other: each is compared with its options once, whatever the number of passes."""
    old = np.array([[0, 0, 10, 4], [20, 10, 30, 14]], float)
    plan = Plan(old, old[:, 1::2].copy(), np.array([1, 1]), np.array([5.0, 5.0]), np.array([0, 0]), [{1: (2.0, 12.0)}, {2: (21.0, 33.0)}], [], (0.0, 50.0), 1.0, np.zeros((2, 2)))
    options = [np.array([(x, x + 10.0) for x in range(6)]), np.array([(x, x + 10.0) for x in range(18, 24)])]
    asked = []
    real = Plan._uncovered
    monkeypatch.setattr(Plan, "_uncovered", lambda self, i, *x: asked.append(i) or real(self, i, *x))
    choose(plan, options, 4)
    assert asked.count(0) == asked.count(1) == 6
    assert all(plan.score(i, *plan.x[i]) == min(plan.score(i, *x) for x in options[i]) for i in range(2))
