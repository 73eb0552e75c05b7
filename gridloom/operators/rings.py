"""Rings of polygons, rectangles by index, and the checks of classes: expressions over one row.

Defined results. A ring is an array of struct x, y without its closing point; a null ring stays null, an empty one empty.
Repeated points are collinear with any neighbour. Null axes are an error of the caller told as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it: an expression named in a lambda is worked out again
    for every element there, and nested ones multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_neighbours(ring: Column, keep) -> Column:
    """The points of a ring for which keep(previous, point, next) holds."""

    def kept(ring: Column) -> Column:
        n = F.size(ring)
        at = lambda i: F.element_at(ring, (F.pmod(i, n) + 1).cast("int"))
        marked = F.transform(ring, lambda p, i: F.struct(p.alias("p"), keep(at(i - 1), p, at(i + 1)).alias("kept")))
        return F.transform(F.filter(marked, lambda m: m["kept"]), lambda m: m["p"])

    return bound(ring, kept)


def without_straight_points(ring: Column, tolerance: float = 1e-9) -> Column:
    """A ring without points at which it does not turn, by the cross product; rings of three points or fewer stay."""
    cross = lambda a, p, b: (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])
    return bound(ring, lambda r: F.when(F.size(r) <= 3, r).otherwise(_with_neighbours(r, lambda a, p, b: F.abs(cross(a, p, b)) > tolerance)))


def without_axis_points(ring: Column) -> Column:
    """A ring without points that have the x of both neighbours, or the y of both."""
    same = lambda c: lambda a, p, b: (a[c] == p[c]) & (p[c] == b[c])
    return _with_neighbours(ring, lambda a, p, b: ~(same("x")(a, p, b) | same("y")(a, p, b)))


def axis_name(axis: Column) -> Column:
    """x or y, of a name in either case with blanks around it, or of 1 or 0; null for any other."""
    low = F.lower(F.trim(axis))
    return F.when(low.isin("x", "1"), "x").when(low.isin("y", "0"), "y")


def restored(rectangles: DataFrame, axis: str) -> DataFrame:
    """Rectangles of a grid that was turned for axis x, turned back."""
    if axis == "y":
        return rectangles
    swap = {"x0": "y0", "y0": "x0", "x1": "y1", "y1": "x1"}
    return rectangles.select(*(F.col(swap.get(c, c)).alias(c) for c in rectangles.columns))


def by_widths(rectangles: DataFrame, widths: DataFrame) -> DataFrame:
    """Rectangles of inclusive cell numbers in lengths from 0 on, given the widths of columns and rows (plan_id, axis, widths):
    plan_id, rect_id, x0, y0, x1, y1. Numbers beyond the grid give null."""
    edges = widths.select("plan_id", "axis", F.transform(F.sequence(F.lit(0), F.size("widths")), lambda k: F.aggregate(F.slice("widths", 1, k), F.lit(0.0), lambda a, b: a + b)).alias("edges"))
    side = lambda a: edges.where(F.col("axis") == a).select("plan_id", F.col("edges").alias(f"{a}s"))
    at = lambda a, i: F.get(F.col(f"{a}s"), i.cast("int"))
    met = rectangles.join(side("x"), "plan_id", "left").join(side("y"), "plan_id", "left")
    return met.select("plan_id", "rect_id", at("x", F.col("x0")).alias("x0"), at("y", F.col("y0")).alias("y0"), at("x", F.col("x1") + 1).alias("x1"), at("y", F.col("y1") + 1).alias("y1"))


def recipe_problems(recipes: DataFrame, classes: DataFrame) -> DataFrame:
    """Recipes (plan_id, cls, layers) with layers in order and what is wrong: `class` below 0, `empty`, or `layer`, one that is
    neither 0 nor a class of the plan; null if nothing is."""
    known = classes.groupBy("plan_id").agg(F.collect_set("cls").alias("known"))
    met = recipes.join(known, "plan_id", "left")
    odd = F.exists("layers", lambda c: c.isNull() | ((c != 0) & ~F.coalesce(F.array_contains("known", c), F.lit(False))))
    problem = F.when(F.col("cls") < 0, "class").when(F.coalesce(F.size("layers"), F.lit(0)) <= 0, "empty").when(odd, "layer")
    return met.select("plan_id", "cls", F.array_sort("layers").alias("layers"), problem.alias("problem"))


def hold_problems(classes: DataFrame, holds: DataFrame) -> DataFrame:
    """Where holds (plan_id, cls, hold) and the classes with bars (plan_id, cls) do not match: plan_id, cls, problem, which is
    `class` (0 or below), `value` (not finite or below 0), `missing` or `unknown`. No rows if all is well."""
    met = classes.where("cls <> 0").select("plan_id", "cls").distinct().withColumn("has", F.lit(True)).join(holds.withColumn("held", F.lit(True)), ["plan_id", "cls"], "full")
    bad = F.col("hold").isNull() | F.isnan("hold") | (F.abs("hold") == float("inf")) | (F.col("hold") < 0)
    problem = F.when(F.col("held").isNull(), "missing").when(F.col("cls") <= 0, "class").when(bad, "value").when(F.col("has").isNull(), "unknown")
    return met.select("plan_id", "cls", problem.alias("problem")).where("problem is not null")


def flat_polygons(geometries: DataFrame) -> DataFrame:
    """The polygons of GeoJSON geometries (poly_id, geometry), in order: poly_id, pos, rings (array of rings of [x, y]).

    Parts of a collection count where they are polygons or have several; a collection in a collection, other types, null, empty
    and unreadable geometries give none."""
    part = "type string, coordinates string"
    g = F.from_json("geometry", f"{part}, geometries array<struct<type: string, coordinates: string>>")
    own = F.array(F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates")))
    parts = geometries.select("poly_id", g.alias("g")).select("poly_id", F.posexplode(F.when(F.col("g.type") == "GeometryCollection", F.col("g.geometries")).otherwise(own)).alias("part", "p"))
    polygon = "array<array<array<double>>>"
    many = F.when(F.col("p.type") == "Polygon", F.array(F.from_json("p.coordinates", polygon))).when(F.col("p.type") == "MultiPolygon", F.from_json("p.coordinates", f"array<{polygon}>"))
    each = parts.select("poly_id", "part", F.posexplode(many).alias("at", "rings")).where(F.size("rings") > 0)
    order = Window.partitionBy("poly_id").orderBy("part", "at")
    return each.select("poly_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "rings")
