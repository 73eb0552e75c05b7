"""Load maps onto fewer grid lines: numbers of lines within a budget, and no load over ground that had a smaller one.

The sides of regions are found by Spark; the rows of a plan then meet in one group, as arrays, where lines are chosen and the
moves by which a load gained ground are forbidden, again and again. Moves are only ever forbidden, so a plan takes no more passes
than it has directions, and no plan waits for another. One very large plan is one task.

Defined results. An empty table gives no rows. A plan whose budget cannot be met has problem `budget` and null lines; one in which
a load gained ground though no side of it moved outward has problem `order`, and the lines of its last pass. Other columns of the
inputs are ignored. Null and repeated cells are as in quantise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.kernels.axes import Axis
from gridloom.kernels.grid import Budget, Guarded, Map, guarded
from gridloom.operators import quantise
from gridloom.session import spread

_EVENT = ("plan_id", "axis", "idx", "coord", "w_minus", "w_plus", "tol_minus", "tol_plus")


def allowed(cells: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """For each plan and load the area where it may be, that of no smaller load before: plan_id, load, area, and for load 0 the
    whole extent."""
    size = lambda e, a: e.select("plan_id", F.col("i").alias(f"i{a}"), (F.col("hi") - F.col("lo")).alias(f"d{a}"))
    each = cells.join(size(x, "x"), ["plan_id", "ix"]).join(size(y, "y"), ["plan_id", "iy"]).groupBy("plan_id", "load").agg(F.sum(F.col("dx") * F.col("dy")).alias("own"))
    return each.select("plan_id", "load", F.sum("own").over(Window.partitionBy("plan_id").orderBy(F.desc("load"))).alias("area"))


def quantised_plans(events: DataFrame, cells: DataFrame, x: DataFrame, y: DataFrame, budget: Budget, guard: bool = True, tolerance: float = 1e-6, dealt: bool = False) -> DataFrame:
    """events with their lines within the budget: locked_minus, locked_plus, scale, stretch, line, cost, cells, problem, and passes
    and worst, how often lines were chosen again and the largest area a load had gained before.

    With guard no load has more than tolerance of ground that had a smaller one, or problem says so. cells are read three times,
    edges twice, so tables that take long to make should be kept. dealt: all tables are dealt by plan, to enough tasks, and stay
    where they are; others move once, together."""
    cols = [c for c in (*_EVENT, "limit") if c in events.columns]
    parts = {"e": (events, cols[1:])}
    if guard:
        sides = quantise.region_sides(cells, x, "x").unionByName(quantise.region_sides(cells, y, "y"))
        parts |= {"c": (cells.where("load > 0"), ["ix", "iy", "load"]), "x": (x, ["i", "lo", "hi"]), "y": (y, ["i", "lo", "hi"]), "s": (sides, ["axis", "coord", "load", "beyond"])}
    rows = [t.select("plan_id", F.struct(*names).alias(k)) for k, (t, names) in parts.items()]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)  # one exchange for all of a plan
    plans_ = (whole if dealt else spread(whole, "plan_id")).groupBy("plan_id").agg(*(F.collect_list(k).alias(k) for k in parts)).where(F.size("e") > 0)
    flat = plans_.select("plan_id", *(F.col(f"{k}.{n}").alias(f"{k}_{n}") for k, (_, names) in parts.items() for n in names))
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    extra = "locked_minus boolean, locked_plus boolean, scale double, passes int, worst double, stretch long, line double, cost double, cells long, problem string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [t for row in batch.to_dict("records") for t in _settled(row, cols[1:], budget, guard, tolerance)]
            if out:
                yield pd.DataFrame({c: np.concatenate([t[c] for t in out]) for c in out[0]})

    return flat.mapInPandas(each, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", " + extra)


def _settled(row: dict, cols: list[str], budget: Budget, guard: bool, tolerance: float) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each axis of one plan, given as arrays, as columns."""
    order = np.argsort(row["e_idx"], kind="stable")
    event = {c: np.asarray(row[f"e_{c}"])[order] for c in cols}
    sides = [{c: v[event["axis"] == a] for c, v in event.items()} for a in ("x", "y")]
    reach = lambda s: np.nan_to_num(s["limit"].astype(float), nan=len(s["idx"]) - 1).astype("int64") if "limit" in s else None
    axes = [Axis(*(s[c].astype(float) for c in ("coord", "w_minus", "w_plus", "tol_minus", "tol_plus")), reach(s)) for s in sides]
    got = Guarded(None, [(np.zeros(a.n, bool), np.zeros(a.n, bool)) for a in axes], 1.0, 0, 0.0, "budget")
    if all(a.n for a in axes):
        got = guarded(axes, budget, _map(row, axes) if guard else None, tolerance)
    for s, axis, (low, high), lines in zip(sides, axes, got.locked, got.lines or (None, None), strict=True):
        if axis.n:
            same = lambda v, kind=float, n=axis.n: np.full(n, v, kind)
            of = None if lines is None else np.searchsorted(lines.begins, np.arange(axis.n), "right") - 1
            made = (same(np.nan),) * 4 if lines is None else (of.astype(float), lines.place[of], same(lines.cost), same(len(lines.begins) - 1))
            told = dict(zip(("stretch", "line", "cost", "cells"), made, strict=True))
            yield {"plan_id": same(row["plan_id"], "int64"), **s, "locked_minus": low, "locked_plus": high, "scale": same(got.scale), "passes": same(got.passes, "int32"), "worst": same(got.worst), **told, "problem": same(got.problem, object)}


def _map(row: dict, axes: list[Axis]) -> Map:
    """The cells of one plan; cells without edges are none, and sides where no event is do not count."""
    array = lambda name, kind=float: np.asarray(() if row[name] is None else row[name], kind)
    at, spans = [], []
    for a in ("x", "y"):
        i, first = np.unique(array(f"{a}_i", "int64"), return_index=True)
        at.append(i)
        spans.append((array(f"{a}_lo")[first], array(f"{a}_hi")[first]))
    places = [array("c_ix", "int64"), array("c_iy", "int64")]
    found = np.isin(places[0], at[0]) & np.isin(places[1], at[1])
    load = np.zeros([len(i) for i in at])
    load[tuple(np.searchsorted(i, p[found]) for i, p in zip(at, places, strict=True))] = array("c_load")[found]
    axis, coord, of, beyond = array("s_axis", object), array("s_coord"), array("s_load"), array("s_beyond", bool)
    sides = []
    for a, line in zip(("x", "y"), axes, strict=True):
        event = np.minimum(np.searchsorted(line.coord, coord), line.n - 1)
        mine = (axis == a) & (line.coord[event] == coord)
        sides.append((event[mine], of[mine], beyond[mine]))
    return Map(load, tuple(spans), tuple(sides))


def plans(lines: DataFrame) -> DataFrame:
    """One row for each plan of quantised_plans."""
    of = lambda c, axis: F.max(F.when(F.col("axis") == axis, F.col(c))).alias(f"{c}_{axis}")
    locked = F.sum(F.col("locked_minus").cast("long") + F.col("locked_plus").cast("long")).alias("locked")
    return lines.groupBy("plan_id").agg(of("cells", "x"), of("cells", "y"), of("cost", "x"), of("cost", "y"), locked, *(F.max(c).alias(c) for c in ("scale", "passes", "worst", "problem")))
