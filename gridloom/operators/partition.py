"""Masks cut into disjoint rectangles: exact partitions for every number, sweeps over numbers, and the least number.

Masks are cells (plan_id, iy, ix, one), sizes (plan_id, axis, i, size) of all columns (x) and rows (y) from 0 on. The search
over one mask is sequential and runs over its cells as one row; everything about numbers is joins and windows.

Defined results. A null cell is no one-cell; a mask without a one-cell is cut into no rectangles, at no cost. A mask with cells
missing or repeated, or without sizes, has the problem `shape`; one with a one-cell that no rectangle may hold, `uncoverable`. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.kernels import partition as kernel
from gridloom.session import spread

_RECTS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
_SIDES = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
_PARTS = pa.schema([("plan_id", pa.int64()), ("n", pa.int64()), ("area", pa.float64()), ("rects", pa.list_(_SIDES)), ("floor", pa.float64()), ("candidates", pa.int64()), ("problem", pa.string())])
_COLUMNS = _PARTS.names[1:]
_TOLERANCE = 1e-7
#: Masks whose rows are sent back at once.
_AT_ONCE = 1000


def partitions(cells: DataFrame, sizes: DataFrame, least: tuple[float, float] = (0.0, 0.0), physical: bool = False, zeros: bool = True) -> DataFrame:
    """For each mask and number of rectangles that can be: plan_id, n, area, rects, floor, candidates, problem.

    Every one-cell is in exactly one rectangle, every other in one at most, none if not zeros. area is the least sum of cells, or
    of areas if physical; floor is that of the one-cells alone, which no choice can undercut; candidates is how many rectangles
    there are to choose from. A mask with a problem has one row."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1))
    held = F.coalesce(F.col("one") > 0, F.lit(False)).cast("double")
    rows = cells.select("plan_id", F.struct(F.lit(0).alias("kind"), whole("iy").alias("i"), whole("ix").alias("j"), held.alias("v")).alias("r"))
    kind = F.when(F.col("axis") == "x", 1).when(F.col("axis") == "y", 2).otherwise(3)
    rows = rows.unionByName(sizes.select("plan_id", F.struct(kind.alias("kind"), whole("i").alias("i"), F.lit(0).cast("long").alias("j"), F.col("size").cast("double").alias("v")).alias("r")))
    masks = spread(rows, "plan_id").groupBy("plan_id").agg(F.sort_array(F.collect_list("r")).alias("r"))

    def one(kind: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> list[dict]:
        """The rows of a mask, whose cells, columns and rows are told by kind, each in order."""
        cell, x, y = (slice(*np.searchsorted(kind, (k, k + 1))) for k in range(3))
        wide, high, ci, cj = v[x], v[y], i[cell], j[cell]
        nx, ny = len(wide), len(high)
        bad = lambda problem, count=0: [dict.fromkeys(_COLUMNS) | {"candidates": count, "problem": problem}]
        full = np.array_equal(i[x], np.arange(nx)) and np.array_equal(i[y], np.arange(ny)) and len(ci) == nx * ny and len(ci)
        if not full or not np.array_equal(ci, np.repeat(np.arange(ny), nx)) or not np.array_equal(cj, np.tile(np.arange(nx), ny)):
            return bad("shape")
        ones = v[cell].reshape(ny, nx) > 0
        some = kernel.rectangles(ones, wide, high, least, physical, zeros)
        reach = 0
        for bits, _, _ in some:
            reach |= bits
        if any(one and not reach >> k & 1 for k, one in enumerate(ones.ravel().tolist())):
            return bad("uncoverable", len(some))
        floor = float((np.outer(high, wide) if physical else np.ones_like(ones, float))[ones].sum())
        xs, ys = ([0.0, *np.cumsum(side).tolist()] for side in (wide, high))
        place = lambda r: {"x0": xs[r[0]], "y0": ys[r[1]], "x1": xs[r[2]], "y1": ys[r[3]]}
        found = sorted(kernel.frontier(ones, some).items())
        return [{"n": n, "area": area, "rects": [place(some[k][2]) for k in chosen], "floor": floor, "candidates": len(some), "problem": None} for n, (area, chosen) in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("r")
            ends, base = listed.offsets.to_numpy(), listed.values
            kind, i, j, v = (base.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "i", "j", "v"))
            plans = batch.column("plan_id").to_pylist()
            for first in range(0, len(plans), _AT_ONCE):
                some = range(first, min(first + _AT_ONCE, len(plans)))
                made = [{"plan_id": plans[k]} | row for k in some for row in one(*(c[ends[k] : ends[k + 1]] for c in (kind, i, j, v)))]
                yield pa.RecordBatch.from_pylist(made, schema=_PARTS)

    got = masks.mapInArrow(run, f"plan_id long, n long, area double, rects {_RECTS}, floor double, candidates long, problem string")
    return got.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("area", "floor")})


def solved(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each number asked (plan_id, n) of a mask (parts as partitions gives them) what solving for it tells: plan_id, n, area,
    rects, is_optimal, reached_floor, reason. Numbers that cannot be have a null area."""
    floor = parts.groupBy("plan_id").agg(F.max("floor").alias("floor"))
    met = asked.select("plan_id", "n").distinct().join(floor.hint("merge"), "plan_id").join(parts.select("plan_id", "n", "area", "rects").hint("merge"), ["plan_id", "n"], "left")
    reached = F.coalesce(F.col("area") <= F.col("floor") + _TOLERANCE, F.lit(False))
    reason = F.when(reached, "solver_and_theoretical_lower_bound").when(F.col("area").isNotNull(), "solver")
    return met.select("plan_id", "n", "area", "rects", F.col("area").isNotNull().alias("is_optimal"), reached.alias("reached_floor"), reason.alias("reason"))


def swept(parts: DataFrame, asked: DataFrame, stop: bool = True) -> DataFrame:
    """The numbers asked in ascending order, each once, negative ones never: plan_id, n, area, skipped, saturation.

    skipped tells why a number has no solution: `candidates` where there are fewer rectangles to choose from, else `infeasible`.
    The first number whose area reaches the floor is the saturation; if stop, the sweep ends there."""
    facts = parts.where("problem is null").groupBy("plan_id").agg(F.max("floor").alias("floor"), F.max("candidates").alias("candidates"))
    met = asked.where("n >= 0").select("plan_id", "n").distinct().join(facts.hint("merge"), "plan_id").join(parts.select("plan_id", "n", "area").hint("merge"), ["plan_id", "n"], "left")
    first = F.min(F.when(F.col("area") <= F.col("floor") + _TOLERANCE, F.col("n"))).over(Window.partitionBy("plan_id"))
    rows = met.withColumn("first", first)
    if stop:
        rows = rows.where("first is null or n <= first")
    skipped = F.when(F.col("n") > F.col("candidates"), "candidates").when(F.col("area").isNull(), "infeasible")
    return rows.select("plan_id", "n", "area", skipped.alias("skipped"), (F.col("first") if stop else F.lit(None).cast("long")).alias("saturation"))


def least_number(parts: DataFrame) -> DataFrame:
    """The least number of rectangles of each mask and their least area: plan_id, n, area, rects, problem."""
    key = F.struct(F.col("n").isNull(), "n")
    return parts.groupBy("plan_id").agg(F.min_by(F.struct("n", "area", "rects", "problem"), key).alias("b")).select("plan_id", "b.*")
