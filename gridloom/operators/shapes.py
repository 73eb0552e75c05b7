"""Polygons of any rings, repaired and united as trapezoids between horizontal lines, by windows over rows.

A shape is what an odd number of its rings' edges lies to the left of, so crossing, nested and touching rings all have an area;
a union is what any shape of it holds. Edges are cut at the heights of all corners and crossings of their key; between two
such heights no edges cross, so their order from the left tells, by running sums, where any shape begins and ends.

The rows of a key (a polygon, or the polygons of one load of a plan) are sorted by windows; edges meet only edges of their own
key whose boxes overlap, to find where they cross.

Defined results. A ring with a null point or coordinate, one that is not finite, or fewer than three different points is none.
Closing and repeated points do not count. Shapes without an area give no trapezoids. Heights nearer than 1e-9 are one. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import rings as flat

#: Heights and widths up to this count as none.
LEAST = 1e-9


def clean_ring(ring: Column) -> Column:
    """A ring (array of struct x, y) without repeated points and without its closing point; null where it is no ring."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])

    def opened(once: Column) -> Column:
        last = F.get(once, F.size(once) - 1)
        return F.when((F.size(once) > 1) & same(last, F.get(once, F.lit(0))), F.slice(once, 1, F.size(once) - 1)).otherwise(once)

    def clean(r: Column) -> Column:
        broken = F.exists(r, lambda p: F.coalesce(~(fine(p["x"]) & fine(p["y"])), F.lit(True)))
        once = F.filter(r, lambda p, i: (i == 0) | (p["x"] != F.get(r, i - 1)["x"]) | (p["y"] != F.get(r, i - 1)["y"]))
        return F.when(~broken, flat.bound(flat.bound(once, opened), lambda o: F.when(F.size(F.array_distinct(o)) >= 3, o)))

    return flat.bound(ring, clean)


def clean_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons (poly_id, rings: the outer one, then holes) as poly_id, rings with clean rings that turn at every point. Holes that
    are no rings go; a polygon whose outer ring is none goes."""
    made = F.transform("rings", lambda r: flat.without_axis_points(clean_ring(r)))
    whole = F.filter(F.array(made), lambda p: F.size(F.get(p, F.lit(0))) >= 3)  # exploded: a filter would make all rings again
    return polygons.select("poly_id", F.explode(whole).alias("rings")).select("poly_id", F.filter("rings", lambda r: r.isNotNull() & (F.size(r) >= 3)).alias("rings"))


def _edges(rings: DataFrame, keys: list[str]) -> DataFrame:
    """The edges of clean rings that are not level, from their lower end: keys, shape, x0, y0, x1, y1."""
    ring = rings.select(*keys, "shape", clean_ring(F.col("points")).alias("r")).where("r is not null")
    ends = ring.select(*keys, "shape", F.explode(F.transform("r", lambda p, i: F.struct(p.alias("a"), F.element_at("r", (F.pmod(i + 1, F.size("r")) + 1).cast("int")).alias("b")))).alias("e"))
    number = lambda c: F.col(f"e.{c}").cast("double")
    up = number("a.y") < number("b.y")
    pick = lambda c, low: F.when(up if low else ~up, number(f"a.{c}")).otherwise(number(f"b.{c}"))
    return ends.where(number("a.y") != number("b.y")).select(*keys, "shape", pick("x", True).alias("x0"), pick("y", True).alias("y0"), pick("x", False).alias("x1"), pick("y", False).alias("y1"))


def _crossings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The heights at which edges of one key cross: keys, y."""
    a = edges.select(*keys, "x0", "y0", "x1", "y1").distinct()
    b = a.withColumnsRenamed({c: f"b{c}" for c in ("x0", "y0", "x1", "y1")})
    near = "by0 < y1 and by1 > y0 and (y0, x0, y1, x1) < (by0, bx0, by1, bx1) and least(bx0, bx1) <= greatest(x0, x1) and greatest(bx0, bx1) >= least(x0, x1)"
    met = a.join(b, keys).where(near)
    met = met.withColumn("turn", F.expr("(x1 - x0) * (by1 - by0) - (y1 - y0) * (bx1 - bx0)")).where("turn <> 0")
    met = met.withColumn("t", F.expr("((bx0 - x0) * (by1 - by0) - (by0 - y0) * (bx1 - bx0)) / turn"))
    return met.withColumn("y", F.expr("y0 + t * (y1 - y0)")).where("y > greatest(y0, by0) and y < least(y1, by1)").select(*keys, "y")


def united(rings: DataFrame, keys: list[str]) -> DataFrame:
    """What the shapes of each key hold: keys, y0, y1, left0, left1, right0, right1 (the sides at y0 and at y1).

    rings: keys, shape, points (array of struct x, y); the rings of one shape, in any order, are its outlines and holes."""
    edges = _edges(rings, keys)
    heights = edges.select(*keys, F.explode(F.array("y0", "y1")).alias("y")).unionByName(_crossings(edges, keys)).distinct()
    above = Window.partitionBy(*keys).orderBy("y")
    slabs = heights.select(*keys, F.col("y").alias("low"), F.lead("y").over(above).alias("high")).where(F.col("high") - F.col("low") > LEAST)
    at = lambda y: F.col("x0") + (F.col(y) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    cut = edges.join(slabs, keys).where("y0 <= low and y1 >= high").select(*keys, "shape", "low", "high", at("low").alias("a"), at("high").alias("b")).withColumn("mid", F.col("a") + F.col("b"))
    slab = Window.partitionBy(*keys, "low", "high")
    own = Window.partitionBy(*keys, "low", "high", "shape").orderBy("mid", "a")
    cut = cut.withColumn("step", F.when(F.row_number().over(own) % 2 == 1, 1).otherwise(-1))
    order = slab.orderBy("mid", F.col("step").desc(), "shape", "a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("held", F.sum("step").over(order)).where((F.col("held") == 0) | ((F.col("held") == 1) & (F.col("step") == 1)))
    pair = slab.orderBy("mid", F.col("step").desc(), "shape", "a")
    out = cut.withColumns({"right0": F.lead("a").over(pair), "right1": F.lead("b").over(pair)}).where("held = 1")
    out = out.where(F.greatest(F.col("right0") - F.col("a"), F.col("right1") - F.col("b")) > LEAST)
    return out.select(*keys, F.col("low").alias("y0"), F.col("high").alias("y1"), F.col("a").alias("left0"), F.col("b").alias("left1"), "right0", "right1")


def measured(trapezoids: DataFrame, keys: list[str]) -> DataFrame:
    """The area of each key and the box around it: keys, area, x0, y0, x1, y1."""
    area = (F.col("y1") - F.col("y0")) * (F.col("right0") - F.col("left0") + F.col("right1") - F.col("left1")) / 2
    return trapezoids.groupBy(*keys).agg(F.sum(area).alias("area"), F.min(F.least("left0", "left1")).alias("x0"), F.min("y0").alias("y0"), F.max(F.greatest("right0", "right1")).alias("x1"), F.max("y1").alias("y1"))


def boxes(polygons: DataFrame) -> DataFrame:
    """The box around each polygon (plan_id, poly_id, load, points) that has an area once repaired: plan_id, poly_id, x0, y0, x1, y1,
    load: what the rest of the library takes for a polygon."""
    keys = ["plan_id", "poly_id", "load"]
    return measured(united(polygons.withColumn("shape", F.lit(0)), keys), keys).select("plan_id", "poly_id", "x0", "y0", "x1", "y1", "load")
