"""Exact-n covers of many plans: the kernel runs once for each plan and n, over that plan's own rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.kernels import cover
from gridloom.operators.searches import by_plan

_SOLUTION = "plan_id long, n int, status string, cost double, zones array<long>"


def solved(bounds: DataFrame, rows: DataFrame, covers: DataFrame, priced: DataFrame, ns: list[int]) -> DataFrame:
    """For each plan with rows to cover and each n the cheapest cover: plan_id, n, status, cost, zones (candidate ids).

    Plans that need more copies of one row than n are infeasible and do not reach the kernel's search."""
    sets = covers.groupBy("plan_id", "cand_id").agg(F.collect_list("row_id").alias("rows"))
    cands = priced.select("plan_id", "cand_id", "cost").join(bounds.select("plan_id", "cand_id", "ub"), ["plan_id", "cand_id"]).join(sets, ["plan_id", "cand_id"], "left")

    def one(plan: int, need: list[tuple], cand: list[tuple]) -> list[tuple]:
        if not need:
            return []
        need, cand = sorted(need), sorted(cand, key=lambda c: c[0])
        at = {r: i for i, (r, _) in enumerate(need)}
        held = np.zeros((len(cand), len(need)), bool)
        for i, (*_, rs) in enumerate(cand):
            held[i, [at[r] for r in rs or ()]] = True
        cost, most = np.array([c[1] for c in cand], float), np.array([c[2] for c in cand], np.int64)
        out = []
        for n in ns:
            status, least, zones = cover.solve(held, np.array([w for _, w in need], np.int64), cost, most, n)
            out.append((plan, n, status, least, [cand[z][0] for z in zones]))
        return out

    return by_plan([rows.select("plan_id", "row_id", "need"), cands.select("plan_id", "cand_id", "cost", "ub", "rows")], one, _SOLUTION)
