"""Axis quantisation: events of grid lines with costs and tolerances, and their clustering.

Events are (plan_id, axis, idx, coord, w_minus, w_plus, tol_minus, tol_plus). Everything is keyed by plan and axis; only the
partitions of one axis, dynamic programs over its lines, run as grouped functions. Edges and lines are looked up in maps of their
plan, joined by merging: tables that are dealt by plan stay where they are, and none is sent to the driver as a small one,
which the file or the cache of a large table may look like.

Defined results. An empty table gives no rows, a plan without loads no events. Other columns are ignored. Null loads count as
no cell; repeated cells or edges are an error of the caller. Regions have no holes; pairs of lines that must stay apart are given
to stretch_limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.kernels.axes import Axis, exact_begins, frontier, greedy_merges, places
from gridloom.operators.raster import by_plan, looked_up
from gridloom.session import spread


#: Rows that a task gives at once.
ROWS = 100_000


def canonical(v: Column, eps: float) -> Column:
    return F.bround(v / eps) * eps


def _sides(cells: DataFrame, edges: DataFrame, axis: str) -> DataFrame:
    """Both regions at each place of a line where the load changes: plan_id, j, coord, of, and whether the region is beyond it."""
    along, across = ("ix", "iy") if axis == "x" else ("iy", "ix")
    w = Window.partitionBy("plan_id", across).orderBy(along)
    here = cells.select("plan_id", F.col(along).alias("i"), F.col(across).alias("j"), "load", F.coalesce(F.lag("load").over(w), F.lit(0)).alias("before"), F.lead(along).over(w).isNull().alias("last"))
    side = lambda of, beyond, end: F.struct(F.col(of).alias("of"), F.lit(beyond).alias("beyond"), F.lit(end).alias("end"))
    differs = F.col("load") != F.col("before")
    turned = F.explode(F.array(F.when(differs, side("load", True, False)), F.when(differs, side("before", False, False)), F.when(F.col("last"), side("load", False, True))))
    sides = here.where(differs | F.col("last")).select("plan_id", "i", "j", turned.alias("t")).where("t.of > 0")
    met = sides.join(by_plan(edges, "i", lows="lo", highs="hi").hint("merge"), "plan_id")
    at = lambda places: F.try_element_at(places, F.col("i"))
    return looked_up(met, coord=F.when(F.col("t.end"), at("highs")).otherwise(at("lows"))).select("plan_id", "j", "coord", "t.of", "t.beyond")


def region_sides(cells: DataFrame, edges: DataFrame, axis: str) -> DataFrame:
    """The lines that bound each region: plan_id, axis, coord, load, beyond."""
    return _sides(cells, edges, axis).select("plan_id", F.lit(axis).alias("axis"), "coord", F.col("of").alias("load"), "beyond").distinct()


def axis_events(
    cells: DataFrame, edges: DataFrame, other: DataFrame, axis: str, shift: float = 0.02, shrink: float = 20.0, expand: float = 1.0, gamma: float = 2.0, base: float = 0.03, least_shrink: float = 0.10, least_expand: float = 0.50
) -> DataFrame:
    """Lines between differing cells with what moving them costs either way and how far they may move.

    All cells of one load are one region; load 0 is none. A side of a region costs its length, times base + r ** gamma, times
    shrink for moves into the region and expand for moves out of it, where r is the load over the 95th percentile of the
    plan's loads, 1 at most. It may move by the fraction shift of the axis's extent, less as r grows, down to least_shrink
    and least_expand of that. The first and the last line stay where they are. Costs add up, tolerances are the least ones."""
    lengths = by_plan(other.select("plan_id", "i", (F.col("hi") - F.col("lo")).alias("length")), "i", lengths="length")
    scale = cells.where("load > 0").select("plan_id", "load").distinct().groupBy("plan_id").agg(F.percentile("load", F.lit(0.95)).alias("scale"))
    each = looked_up(_sides(cells, edges, axis).join(lengths.hint("merge"), "plan_id"), length=F.try_element_at("lengths", F.col("j"))).join(scale.hint("merge"), "plan_id")
    term = F.pow(F.least(F.col("of") / F.col("scale"), F.lit(1.0)), F.lit(gamma))
    weight = F.col("length") * (F.lit(base) + term)
    inward, outward = 1.0 - (1.0 - least_shrink) * term, 1.0 - (1.0 - least_expand) * term
    pick = lambda low, high: F.when(F.col("beyond"), low).otherwise(high)
    got = each.groupBy("plan_id", "coord").agg(
        F.sum(weight * pick(F.lit(expand), F.lit(shrink))).alias("w_minus"), F.sum(weight * pick(F.lit(shrink), F.lit(expand))).alias("w_plus"), F.min(pick(outward, inward)).alias("t_minus"), F.min(pick(inward, outward)).alias("t_plus")
    )
    order, whole = Window.partitionBy("plan_id").orderBy("coord"), Window.partitionBy("plan_id")
    first, last = F.min("coord").over(whole), F.max("coord").over(whole)
    tol = lambda c: F.when((F.col("coord") == first) | (F.col("coord") == last), 0.0).otherwise((last - first) * F.lit(shift) * F.col(c))
    return got.select("plan_id", F.lit(axis).alias("axis"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "coord", "w_minus", "w_plus", tol("t_minus").alias("tol_minus"), tol("t_plus").alias("tol_plus"))


def scaled_tolerances(events: DataFrame, factor: int) -> DataFrame:
    return events.withColumns({c: F.col(c) * factor for c in ("tol_minus", "tol_plus")})


def locked(events: DataFrame, minus: Column, plus: Column) -> DataFrame:
    """Events without tolerance in the directions that are locked."""
    return events.withColumns({"tol_minus": F.when(minus, 0).otherwise(F.col("tol_minus")), "tol_plus": F.when(plus, 0).otherwise(F.col("tol_plus"))})


def stretch_limits(events: DataFrame, apart: DataFrame) -> DataFrame:
    """events with limit, the idx of the last event that may share a line with it, null without one.

    apart (plan_id, axis, low, high) are places that must never become one, such as the two sides of a hole; pairs of which an
    end is no event, or is not below the other, do not count. No stretch holds both ends of a pair, so it ends before the least
    high end of all pairs that begin in it or later."""
    at = events.select("plan_id", "axis", "coord", "idx")
    ends = apart.join(at.withColumnsRenamed({"coord": "low", "idx": "a"}), ["plan_id", "axis", "low"]).join(at.withColumnsRenamed({"coord": "high", "idx": "b"}), ["plan_id", "axis", "high"])
    first = ends.where("a < b").groupBy("plan_id", "axis", F.col("a").alias("idx")).agg((F.min("b") - 1).alias("own"))
    later = Window.partitionBy("plan_id", "axis").orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    return events.join(first, ["plan_id", "axis", "idx"], "left").withColumn("limit", F.min("own").over(later)).select(*events.columns, "limit")


def minimum_lines(events: DataFrame) -> DataFrame:
    """The least number of lines that an axis can be cut into: neighbours in order share a line as long as one place is within
    the tolerance of all of them, and none is past the limit of the first, if events have limits."""
    far = F.coalesce("limit", F.lit(1 << 62)) if "limit" in events.columns else F.lit(1 << 62)
    spans = F.array_sort(F.collect_list(F.struct("idx", (F.col("coord") - F.col("tol_minus")).cast("double").alias("lo"), (F.col("coord") + F.col("tol_plus")).cast("double").alias("hi"), far.cast("long").alias("far"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi"), F.lit(-1).cast("long").alias("far"))
    lo, hi = (lambda s, e: F.greatest(s["lo"], e["lo"])), (lambda s, e: F.least(s["hi"], e["hi"]))
    new = lambda s, e: F.struct((s["n"] + 1).alias("n"), e["lo"].alias("lo"), e["hi"].alias("hi"), e["far"].alias("far"))
    step = lambda s, e: F.when((lo(s, e) > hi(s, e) + 1e-12) | (e["idx"] > s["far"]), new(s, e)).otherwise(F.struct(s["n"].alias("n"), lo(s, e).alias("lo"), hi(s, e).alias("hi"), s["far"].alias("far")))
    return events.groupBy("plan_id", "axis").agg(spans.alias("spans")).select("plan_id", "axis", F.aggregate("spans", start, step)["n"].alias("lines"))


def _by_axis(events: DataFrame, run: Callable[[Axis], dict], schema: str) -> DataFrame:
    """run over the lines of each plan and axis, with their limits if they have any; its columns with those two before them.

    Axes come as arrays, many in a batch: a frame for each of them would take longer than most searches."""
    columns = ["idx", "coord", "w_minus", "w_plus", "tol_minus", "tol_plus", *(["limit"] if "limit" in events.columns else [])]
    rows = spread(events.select("plan_id", "axis", F.struct(*columns).alias("e")), "plan_id", "axis")
    packed = rows.groupBy("plan_id", "axis").agg(F.array_sort(F.collect_list("e")).alias("e"))

    def one(row: dict) -> dict[str, np.ndarray]:
        limit = np.nan_to_num(np.asarray(row["limit"], float), nan=len(row["idx"]) - 1).astype("int64") if "limit" in row else None
        got = run(Axis(*(np.asarray(row[c], float) for c in columns[1:6]), limit))
        n = len(next(iter(got.values())))
        return {c: np.full(n, v, object) if v is None or isinstance(v, str) else np.asarray(v) for c, v in ({"plan_id": [row["plan_id"]] * n, "axis": row["axis"]} | got).items()}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for row in batch.to_dict("records"):
                held.append(one(row))
                size += len(held[-1]["plan_id"])
                if size >= ROWS:
                    yield _joined(held)
                    held, size = [], 0
            if size:
                yield _joined(held)

    return packed.select("plan_id", "axis", *(F.col(f"e.{c}").alias(c) for c in columns)).mapInPandas(each, "plan_id long, axis string, " + schema)


def _joined(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    parts = [p for p in parts if len(p["plan_id"])]
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})


def segment_costs(events: DataFrame) -> DataFrame:
    """For each stretch of events i..j the cost of moving all to one place, the weighted median as far as their tolerances
    allow, and that place: null if there is none."""

    def run(axis: Axis) -> dict:
        cost, place = axis.table()
        i, j = np.triu_indices(axis.n)
        return {"i": i, "j": j, "cost": np.where(np.isfinite(cost[i, j]), cost[i, j], np.nan), "place": place[i, j]}

    got = _by_axis(events, run, "i long, j long, cost double, place double")
    return got.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("cost", "place")})


def exact_partitions(events: DataFrame, most: int | None = None) -> DataFrame:
    """For each plan, axis and number of stretches, up to most or the axis's events, the least total cost, where there is one."""

    def run(axis: Axis) -> dict:
        costs, _ = frontier(axis.table()[0], axis.n if most is None else most)
        k = np.flatnonzero(np.isfinite(costs))
        return {"k": k + 1, "cost": costs[k]}

    return _by_axis(events, run, "k int, cost double")


def greedy_partitions(events: DataFrame) -> DataFrame:
    """For each plan, axis and number of stretches the cost after merging the cheapest neighbours again and again."""

    def run(axis: Axis) -> dict:
        _, totals = greedy_merges(axis)
        return {"k": axis.n - np.arange(len(totals) + 1), "cost": [0.0, *totals]}

    return _by_axis(events, run, "k int, cost double")


def quantised(events: DataFrame, lines: int, greedy: bool = False) -> DataFrame:
    """Each event's line where an axis is cut into a number of stretches, of the least cost or by greedy merges: plan_id, axis,
    idx, coord, stretch, line, problem. Axes with no more events keep them; where tolerances need more lines, line is null
    and problem is `lines`."""

    def run(axis: Axis) -> dict:
        begins = None
        if lines >= axis.n:
            begins = np.arange(axis.n)
        elif greedy:
            gone, _ = greedy_merges(axis)
            if axis.n - len(gone) <= lines:
                begins = np.setdiff1d(np.arange(axis.n), gone[: axis.n - lines])
        else:
            costs, all_begins = frontier(axis.table()[0], lines)
            if np.isfinite(costs[lines - 1]):
                begins = exact_begins(all_begins, axis.n, lines)
        rows = {"idx": np.arange(axis.n), "coord": axis.coord.astype("int64")}
        if begins is None:
            return rows | {"stretch": None, "line": None, "problem": "lines"}
        _, place = places(axis, begins)
        of = np.searchsorted(begins, np.arange(axis.n), "right") - 1
        return rows | {"stretch": of, "line": place[of], "problem": None}

    return _by_axis(events, run, "idx long, coord long, stretch long, line double, problem string")


def snapped(cells: DataFrame, x: DataFrame, y: DataFrame, moves: DataFrame) -> DataFrame:
    """Cells with a load on lines that moved (moves is quantised of both axes): plan_id, load, x0, y0, x1, y1; cells whose
    sides met are gone. Lines without an event do not bound a region; they go with the event before them."""

    def sides(edges: DataFrame, axis: str) -> DataFrame:
        """Where each line pair of a plan moved to, as a map of the plan."""
        marks = moves.where((F.col("axis") == axis) & F.col("line").isNotNull()).groupBy("plan_id").agg(F.collect_list(F.struct("coord", "line")).alias("marks"))
        line = lambda end: F.array_max(F.filter("marks", lambda m: m["coord"] <= F.col(end)))["line"]
        ends = edges.join(marks.hint("merge"), "plan_id").select("plan_id", "i", F.struct(line("lo").alias("low"), line("hi").alias("high")).alias("ends"))
        return by_plan(ends, "i", **{f"{axis}s": "ends"}).hint("merge")

    met = cells.where("load > 0").join(sides(x, "x"), "plan_id").join(sides(y, "y"), "plan_id")
    found = looked_up(met, xe=F.try_element_at("xs", F.col("ix")), ye=F.try_element_at("ys", F.col("iy")))
    placed = found.select("plan_id", "load", *(F.col(f"{a}e.{end}").alias(f"{a}{k}") for k, end in enumerate(("low", "high")) for a in "xy"))
    return placed.where("x1 > x0 and y1 > y0")


def order_violations(snapped_cells: DataFrame, cells: DataFrame, x: DataFrame, y: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per plan and load, the area of snapped cells where the plan had a smaller load, if above the tolerance."""
    span = lambda e, a: e.select("plan_id", F.col("i").alias(f"i{a}"), F.col("lo").alias(f"{a}lo"), F.col("hi").alias(f"{a}hi"))
    old = cells.join(span(x, "x"), ["plan_id", "ix"]).join(span(y, "y"), ["plan_id", "iy"]).withColumnRenamed("load", "had")
    shared = lambda a: F.least(f"{a}1", f"{a}hi") - F.greatest(f"{a}0", f"{a}lo")
    met = snapped_cells.join(old, "plan_id").where((F.col("had") >= F.col("load")) & (shared("x") > 0) & (shared("y") > 0))
    held = met.groupBy("plan_id", "load").agg(F.sum(shared("x") * shared("y")).alias("held"))
    area = snapped_cells.groupBy("plan_id", "load").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    over = F.col("area") - F.coalesce("held", F.lit(0.0))
    return area.join(held, ["plan_id", "load"], "left").where(over > tolerance).select("plan_id", "load", over.alias("outside"))


def ground_gained(snapped_cells: DataFrame, cells: DataFrame, x: DataFrame, y: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """order_violations where no two cells are paired: each snapped cell looks up the plan's lines and loads, which come to it as
    arrays and maps, and goes along the lines that it overlaps."""
    lines = lambda edges, a: edges.groupBy("plan_id").agg(F.collect_list(F.struct("i", "lo", "hi")).alias(f"{a}s")).hint("merge")
    rows = cells.where("load > 0").groupBy("plan_id", "iy").agg(F.map_from_entries(F.collect_list(F.struct("ix", "load"))).alias("row"))
    met = snapped_cells.join(lines(x, "x"), "plan_id", "left").join(lines(y, "y"), "plan_id", "left").join(by_plan(rows, "iy", loads="row").hint("merge"), "plan_id", "left")
    shared = lambda a, e: F.greatest(F.least(F.col(f"{a}1"), e["hi"]) - F.greatest(F.col(f"{a}0"), e["lo"]), F.lit(0.0)).cast("double")
    summed = lambda a, length: F.coalesce(F.aggregate(f"{a}s", F.lit(0.0), lambda s, e: s + F.when(shared(a, e) > 0, shared(a, e) * length(e)).otherwise(F.lit(0.0))), F.lit(0.0))
    had = lambda ex, ey: F.try_element_at(F.try_element_at("loads", ey["i"]), ex["i"])
    held = summed("x", lambda ex: summed("y", lambda ey: F.when(had(ex, ey) >= F.col("load"), F.lit(1.0)).otherwise(F.lit(0.0))))
    over = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - held
    return met.select("plan_id", "load", over.alias("over")).groupBy("plan_id", "load").agg(F.sum("over").alias("outside")).where(F.col("outside") > tolerance)


def nearest_lines(values: DataFrame, lines: DataFrame, within: int) -> DataFrame:
    """For each value (plan_id, v) the nearest line (plan_id, coord), the lower of two equally near; null if none is near enough."""
    both = values.select("plan_id", F.col("v").alias("at"), F.lit(1).alias("kind")).distinct().unionByName(lines.select("plan_id", F.col("coord").alias("at"), F.lit(0).alias("kind")))
    up, down = Window.partitionBy("plan_id").orderBy("at", "kind"), Window.partitionBy("plan_id").orderBy(F.desc("at"), "kind")
    line = F.when(F.col("kind") == 0, F.col("at"))
    got = both.withColumn("low", F.last(line, True).over(up)).withColumn("high", F.last(line, True).over(down)).where("kind = 1")
    near = F.when(F.col("high").isNull() | (F.col("at") - F.col("low") <= F.col("high") - F.col("at")), F.col("low")).otherwise(F.col("high"))
    return got.select("plan_id", F.col("at").alias("v"), F.when(F.abs(F.col("at") - near) <= within, near).alias("coord"))


def spaced(lines: DataFrame, width: float, slack: float = 1e-9) -> DataFrame:
    """Lines (plan_id, axis, idx, line, lower, upper) moved as little as keeps neighbours width apart within their bounds:
    plan_id, axis, idx, line, moved; moved is null on axes where it cannot be done.

    In places less idx * width the earliest of a line is the running greatest bound, the latest the running least one from
    the other end, and the forward chain of clipped lines a running greatest."""
    base = F.col("idx") * width
    order = Window.partitionBy("plan_id", "axis").orderBy("idx")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = lines.withColumns({"early": F.max(F.col("lower") - base).over(past), "late": F.min(F.col("upper") - base).over(ahead)})
    rows = rows.withColumn("ok", F.min(F.col("early") <= F.col("late") + slack).over(Window.partitionBy("plan_id", "axis")))
    kept = F.max(F.least(F.greatest(F.col("line") - base, F.col("early")), F.col("late"))).over(past) + base
    return rows.select("plan_id", "axis", "idx", "line", F.when(F.col("ok"), kept).alias("moved"))
