"""Mosaic: connected cells of one class that no rectangle's side separates, and its refinement to units that no rectangle cuts.

Defined results. Repeated cells and rectangles count once where units are made. A null label or profile is a value of its own.
Plans without cells have no units; rectangles of plans without cells, and sides outside the cells, separate nothing. Empty
tables give empty ones. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import groups
from gridloom.session import held


def _place(y: str, x: str) -> Column:
    return F.col(y) * (1 << 20) + F.col(x)


def boundary_support(rects: DataFrame) -> DataFrame:
    """How many rectangles have a side between a cell and its right ('x') or upper ('y') neighbour: plan_id, side, iy, ix, support."""
    down = F.sequence("y0", "y1")
    along = F.sequence("x0", "x1")
    right = rects.withColumn("iy", F.explode(down)).select("plan_id", F.lit("x").alias("side"), "iy", F.explode(F.array(F.col("x0") - 1, F.col("x1"))).alias("ix"))
    upper = rects.withColumn("ix", F.explode(along)).select("plan_id", F.lit("y").alias("side"), F.explode(F.array(F.col("y0") - 1, F.col("y1"))).alias("iy"), "ix")
    return right.unionByName(upper).groupBy("plan_id", "side", "iy", "ix").agg(F.count(F.lit(1)).alias("support"))


def mosaic(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """The label of each cell with a class: the least iy * 2**20 + ix that it is connected with: plan_id, iy, ix, label."""
    full = cells.where("cls > 0").select("plan_id", "iy", "ix", "cls")
    sides = boundary_support(rects)
    steps = full.select("plan_id", "iy", "ix", "cls", F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("iy").alias("jy"), (F.col("ix") + 1).alias("jx")), F.struct(F.lit("y").alias("side"), (F.col("iy") + 1).alias("jy"), F.col("ix").alias("jx")))).alias("s"))
    steps = steps.select("plan_id", "iy", "ix", "cls", "s.side", "s.jy", "s.jx").join(full.select("plan_id", F.col("iy").alias("jy"), F.col("ix").alias("jx"), "cls"), ["plan_id", "jy", "jx", "cls"]).join(sides, ["plan_id", "side", "iy", "ix"], "left_anti")
    roots = groups.connected(steps.select("plan_id", _place("iy", "ix").alias("a"), _place("jy", "jx").alias("b"))).withColumnRenamed("node", "place")
    out = full.withColumn("place", _place("iy", "ix")).join(roots, ["plan_id", "place"], "left")
    return out.select("plan_id", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.coalesce("root", "place").alias("label"))


def _changes(rects: DataFrame) -> DataFrame:
    """Where sides of rectangles start and end on each line: plan_id, side, line, at, change, in one pass over the rectangles.

    Each side of a rectangle is a rise at its start and a fall after its end, so work follows the number of rectangles, not
    their perimeters. Repeated rectangles raise the sums, but none to or from 0."""
    end = lambda side, line, at, change: F.struct(F.lit(side).alias("side"), line.alias("line"), at.alias("at"), F.lit(change).alias("change"))
    ends = [
        end(side, line, at, change)
        for side, low, high, start, stop in (("x", "x0", "x1", "y0", "y1"), ("y", "y0", "y1", "x0", "x1"))
        for line in (F.col(low) - 1, F.col(high))
        for at, change in ((F.col(start), 1), (F.col(stop) + 1, -1))
    ]
    return rects.select("plan_id", F.inline(F.array(*ends))).groupBy("plan_id", "side", "line", "at").agg(F.sum("change").alias("change")).where("change <> 0")


def _together(cells: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """Neighbours to the right (side x) or above (side y) that agree and that no rectangle's side separates: plan_id, a, b. The
    running sum of changes at a cell tells how many sides lie between it and the next one."""
    line, at = ("ix", "iy") if side == "x" else ("iy", "ix")
    changes = changes.where(F.col("side") == side).drop("side")
    follows = Window.partitionBy("plan_id", "at").orderBy("line")
    here = cells.select("plan_id", F.col(line).alias("line"), F.col(at).alias("at"), "label", "profile", _place("iy", "ix").alias("a"))
    same = F.lead("label").over(follows).eqNullSafe(F.col("label")) & F.lead("profile").over(follows).eqNullSafe(F.col("profile"))
    pairs = here.withColumn("b", F.when((F.lead("line").over(follows) == F.col("line") + 1) & same, F.lead("a").over(follows))).where("b is not null")
    rows = pairs.select("plan_id", "line", "at", F.lit(0).cast("long").alias("change"), "a", "b").unionByName(changes, allowMissingColumns=True)
    passed = Window.partitionBy("plan_id", "line").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("sides", F.sum("change").over(passed)).where("a is not null and sides = 0").select("plan_id", "a", "b")


def refined(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """Cells (plan_id, iy, ix, label, profile) with the unit that each belongs to: plan_id, iy, ix, unit, root.

    A unit is connected, has one label and one profile, and no rectangle (plan_id, x0, y0, x1, y1) holds only a part of it, so
    one row can stand for all of its cells. Units count from 0 in the order of their first cell (least iy, then ix), the root."""
    cells = held(cells.select("plan_id", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "label", "profile").dropDuplicates(["plan_id", "iy", "ix"]))
    changes = held(_changes(rects.select("plan_id", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))))
    roots = groups.connected(_together(cells, changes, "x").unionByName(_together(cells, changes, "y"))).withColumnRenamed("node", "place")
    placed = cells.withColumn("place", _place("iy", "ix")).join(roots, ["plan_id", "place"], "left").withColumn("root", F.coalesce("root", "place"))
    numbers = placed.select("plan_id", "root").distinct().withColumn("unit", (F.row_number().over(Window.partitionBy("plan_id").orderBy("root")) - 1).cast("long"))
    return placed.join(numbers, ["plan_id", "root"]).select("plan_id", "iy", "ix", "label", "profile", "unit", "root")


def unit_rows(units: DataFrame) -> DataFrame:
    """One row for each unit of refined(): plan_id, unit, iy and ix of its first cell, label, profile, size."""
    got = units.groupBy("plan_id", "unit", "root").agg(F.first("label").alias("label"), F.first("profile").alias("profile"), F.count(F.lit(1)).alias("size"))
    return got.select("plan_id", "unit", F.shiftright("root", 20).alias("iy"), F.col("root").bitwiseAND((1 << 20) - 1).alias("ix"), "label", "profile", "size")


def label_problem(labels: DataFrame, shapes: DataFrame) -> DataFrame:
    """What is wrong with the labels (plan_id, iy, ix, label double) of each of shapes (plan_id, ny, nx): `shape` where cells are
    missing, repeated or outside, else `finite`, else `integer`, else null. A null label is not finite."""
    inside = F.expr("iy >= 0 and iy < ny and ix >= 0 and ix < nx")
    rows = labels.join(shapes, "plan_id").groupBy("plan_id", "ny", "nx", "iy", "ix").agg(
        F.count(F.lit(1)).alias("copies"),
        F.bool_and(F.coalesce(~F.isnan("label") & (F.abs("label") != float("inf")), F.lit(False))).alias("finite"),
        F.bool_and(F.coalesce(F.col("label") == F.floor("label"), F.lit(False))).alias("whole"),
    )
    got = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("cells"), F.bool_and(F.coalesce(inside, F.lit(False)) & (F.col("copies") == 1)).alias("placed"), F.bool_and("finite").alias("finite"), F.bool_and("whole").alias("whole"))
    shaped = (F.coalesce("cells", F.lit(0)) == F.col("ny") * F.col("nx")) & F.coalesce("placed", F.lit(True))
    problem = F.when(~shaped, "shape").when(~F.col("finite"), "finite").when(~F.col("whole"), "integer")
    return shapes.join(got, "plan_id", "left").select("plan_id", problem.alias("problem"))


def units_inside(units: DataFrame, rects: DataFrame) -> DataFrame:
    """The units (plan_id, iy, ix, unit) that each rectangle (plan_id, rect_id, x0, y0, x1, y1) meets, and whether it cuts them:
    plan_id, rect_id, unit, cut. Cells of no unit (null or below 0) and repeated cells do not count."""
    own = units.where("unit >= 0").select("plan_id", "iy", "ix", "unit").distinct()
    size = own.groupBy("plan_id", "unit").agg(F.count(F.lit(1)).alias("size"))
    met = own.alias("u").join(rects.alias("r"), F.expr("u.plan_id = r.plan_id and u.ix between r.x0 and r.x1 and u.iy between r.y0 and r.y1"))
    met = met.groupBy("u.plan_id", "r.rect_id", "u.unit").agg(F.count(F.lit(1)).alias("n"))
    return met.join(size, ["plan_id", "unit"]).select("plan_id", "rect_id", "unit", (F.col("n") < F.col("size")).alias("cut"))
