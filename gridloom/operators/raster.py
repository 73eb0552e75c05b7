"""Load maps: boxes onto compressed grids, their compaction, orientation and world coordinates.

Cells are (plan_id, iy, ix, load), load null where no box covers; edges are (plan_id, axis, i, lo, hi). Every join has plan_id
as its key, so plans spread over the cluster and none needs another's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import spread


def bounding_boxes(polygons: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of polygons (points: array of struct x, y)."""
    side = lambda f, c: f(F.transform("points", lambda p: p[c]))
    return polygons.select("plan_id", "poly_id", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"), "load")


def ring_area(points: Column) -> Column:
    """Area of a ring by the shoelace rule."""
    turned = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    crosses = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c)) / 2


def axis_lines(boxes: DataFrame, axis: str) -> DataFrame:
    """Distinct coordinates of one axis: plan_id, i, lo, hi (null after the last)."""
    lines = boxes.select("plan_id", F.explode(F.array(f"{axis}0", f"{axis}1")).alias("lo")).distinct()
    w = Window.partitionBy("plan_id").orderBy("lo")
    return lines.select("plan_id", (F.row_number().over(w) - 1).cast("long").alias("i"), "lo", F.lead("lo").over(w).alias("hi"))


def _cells(boxes: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    x = x.where("hi is not null").select("plan_id", F.col("i").alias("ix"), F.col("lo").alias("xl"), F.col("hi").alias("xh"))
    y = y.where("hi is not null").select("plan_id", F.col("i").alias("iy"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    covers = "b.plan_id = g.plan_id and b.x0 <= g.xl and b.x1 >= g.xh and b.y0 <= g.yl and b.y1 >= g.yh"
    got = y.join(x, "plan_id").alias("g").join(boxes.alias("b"), F.expr(covers), "left")
    return got.groupBy("g.plan_id", "g.iy", "g.ix").agg(F.max("b.load").alias("load"))


def rasterised(boxes: DataFrame) -> DataFrame:
    """Cells between all coordinates, each with the highest load over it."""
    return _cells(boxes, axis_lines(boxes, "x"), axis_lines(boxes, "y"))


def kept_lines(cells: DataFrame, axis: str) -> DataFrame:
    """Lines across which some load differs, uncovered counting as a load of its own: plan_id, line, k."""
    along, across = ("ix", "iy") if axis == "x" else ("iy", "ix")
    w = Window.partitionBy("plan_id", across).orderBy(along)
    rows = cells.select("plan_id", along, "load", F.lag("load").over(w).alias("before"), F.lead(along).over(w).isNull().alias("last"))
    inner = F.when(~F.col("load").eqNullSafe(F.col("before")), F.col(along))
    outer = F.when(F.col("last") & F.col("load").isNotNull(), F.col(along) + 1)
    lines = rows.select("plan_id", F.explode(F.array(inner, outer)).alias("line")).where("line is not null").distinct()
    return lines.withColumn("k", (F.row_number().over(Window.partitionBy("plan_id").orderBy("line")) - 1).cast("long"))


def compacted(cells: DataFrame) -> DataFrame:
    """Cells between kept lines only, uncovered ones with load 0."""
    last = Window.partitionBy("plan_id")
    take = lambda axis: kept_lines(cells, axis).withColumn("top", F.max("k").over(last)).where("k < top").select("plan_id", F.col("line").alias(f"i{axis}"), F.col("k").alias(f"k{axis}"))
    got = cells.join(by_plan(take("x"), "ix", xs="kx"), "plan_id").join(by_plan(take("y"), "iy", ys="ky"), "plan_id")
    got = looked_up(got, kx=F.try_element_at("xs", F.col("ix")), ky=F.try_element_at("ys", F.col("iy")))
    return got.select("plan_id", F.col("ky").alias("iy"), F.col("kx").alias("ix"), F.coalesce("load", F.lit(0)).alias("load"))


def compact_edges(boxes: DataFrame, cells: DataFrame, axis: str) -> DataFrame:
    """Kept lines of one axis as edges: plan_id, i, lo, hi."""
    w = Window.partitionBy("plan_id").orderBy("k")
    lines = kept_lines(cells, axis).join(by_plan(axis_lines(boxes, axis), "i", places="lo"), "plan_id")
    return looked_up(lines, lo=F.try_element_at("places", F.col("line"))).select("plan_id", F.col("k").alias("i"), "lo", F.lead("lo").over(w).alias("hi")).where("hi is not null")


def load_matrix(boxes: DataFrame) -> DataFrame:
    """Cells by their centres, not-a-number where nothing covers."""
    return rasterised(boxes).withColumn("load", F.coalesce(F.col("load").cast("double"), F.lit(float("nan"))))


def resolved(boxes: DataFrame) -> DataFrame:
    """Area left to each box after higher loads, and earlier boxes of equal loads, took theirs."""
    x, y = axis_lines(boxes, "x").where("hi is not null"), axis_lines(boxes, "y").where("hi is not null")
    g = y.select("plan_id", F.col("lo").alias("yl"), F.col("hi").alias("yh")).join(x.select("plan_id", F.col("lo").alias("xl"), F.col("hi").alias("xh")), "plan_id")
    covers = "b.plan_id = g.plan_id and b.x0 <= g.xl and b.x1 >= g.xh and b.y0 <= g.yl and b.y1 >= g.yh"
    owner = g.alias("g").join(boxes.alias("b"), F.expr(covers)).groupBy("g.plan_id", "xl", "xh", "yl", "yh").agg(F.min_by("b.poly_id", F.struct(-F.col("b.load"), F.col("b.poly_id"))).alias("poly_id"))
    return owner.groupBy("plan_id", "poly_id").agg(F.sum((F.col("xh") - F.col("xl")) * (F.col("yh") - F.col("yl"))).alias("area"))


def oriented(cells: DataFrame, axis: Column) -> DataFrame:
    """Cells with rows and columns exchanged where the work axis is x."""
    swap = F.lower(axis) == "x"
    return cells.select("plan_id", F.when(swap, F.col("ix")).otherwise(F.col("iy")).alias("iy"), F.when(swap, F.col("iy")).otherwise(F.col("ix")).alias("ix"), "load")


def by_plan(rows: DataFrame, key: str, **maps: str) -> DataFrame:
    """A plan's rows as maps from key to a column each, so that rows of the plan find them where they stand, without moving by key."""
    entries = {name: F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(c)))).alias(name) for name, c in maps.items()}
    return rows.groupBy("plan_id").agg(*entries.values())


def looked_up(rows: DataFrame, **found: Column) -> DataFrame:
    """rows with what was found for them; those for which something was not are left out."""
    out = rows.withColumns(found)
    for name in found:
        out = out.where(F.col(name).isNotNull())
    return out


def to_world(rects: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """rects (plan_id, x0, y0, x1, y1 as inclusive cell places, and more) with wx0, wy0, wx1, wy1."""
    out = rects.join(by_plan(x, "i", x_lo="lo", x_hi="hi"), "plan_id").join(by_plan(y, "i", y_lo="lo", y_hi="hi"), "plan_id")
    at = lambda lines, place: F.try_element_at(lines, F.col(place).cast("long"))
    out = looked_up(out, wx0=at("x_lo", "x0"), wy0=at("y_lo", "y0"), wx1=at("x_hi", "x1"), wy1=at("y_hi", "y1"))
    return out.select(*rects.columns, "wx0", "wy0", "wx1", "wy1")


def distortion(boxes: DataFrame, snapped: DataFrame) -> DataFrame:
    """For each plan and load: area of the original, area lost by the snapped boxes, area they gained."""
    both = boxes.unionByName(snapped)
    x, y = axis_lines(both, "x").where("hi is not null"), axis_lines(both, "y").where("hi is not null")
    mark = lambda b, name: _cells(b, x, y).where("load is not null").select("plan_id", "iy", "ix", F.col("load").alias(name))
    span = lambda e, i, s: e.select("plan_id", F.col("i").alias(i), (F.col("hi") - F.col("lo")).alias(s))
    cells = mark(boxes, "a").join(mark(snapped, "b"), ["plan_id", "iy", "ix"], "full").join(span(x, "ix", "w"), ["plan_id", "ix"]).join(span(y, "iy", "h"), ["plan_id", "iy"])
    area = F.col("w") * F.col("h")
    rows = cells.select("plan_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("load"), "a", "b", area.alias("area")).where("load is not null")
    held = lambda c: F.coalesce(F.col(c) == F.col("load"), F.lit(False))
    total = lambda test, name: F.sum(F.when(test, F.col("area")).otherwise(0)).alias(name)
    return rows.groupBy("plan_id", "load").agg(total(held("a"), "area"), total(held("a") & ~held("b"), "lost"), total(held("b") & ~held("a"), "gained"))


def _chance(*parts: Column) -> Column:
    """A number from 0 on and below 1 that follows from the parts alone, so that lost tasks make the same grid again."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def random_sizes(grids: DataFrame) -> DataFrame:
    """Sizes of the columns (x) and rows (y) of random grids (plan_id, m, share, low, high, seed): plan_id, axis, i, size."""
    lines = _sound(grids).select("*", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis")).select("*", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("i"))
    return lines.select("plan_id", "axis", "i", F.round(F.col("low") + (F.col("high") - F.col("low")) * _chance(F.col("seed"), F.col("axis"), F.col("i")), 3).alias("size"))


def random_mask(grids: DataFrame) -> DataFrame:
    """The cells of random grids (plan_id, m, share, low, high, seed), each one with the chance share: plan_id, iy, ix, one.

    Where none would be one, a cell chosen by the seed is. A grid's row alone tells its cells, so only grids are dealt."""
    axis = F.sequence(F.lit(0), F.col("m").cast("int") - 1)
    one = lambda iy, ix: _chance(F.col("seed"), iy, ix) < F.col("share")
    pick = lambda name: F.floor(_chance(F.col("seed"), F.lit(name)) * F.col("m"))
    some = F.exists(axis, lambda iy: F.exists(axis, lambda ix: one(iy, ix)))
    given = F.when(~some, F.struct(pick("row").alias("iy"), pick("column").alias("ix")))
    dealt = spread(_sound(grids), "plan_id").withColumn("given", given)
    cells = dealt.withColumn("iy", F.explode(axis)).withColumn("ix", F.explode(axis))
    chosen = F.coalesce((F.col("iy") == F.col("given.iy")) & (F.col("ix") == F.col("given.ix")), F.lit(False))
    return cells.select("plan_id", "iy", "ix", (one(F.col("iy"), F.col("ix")) | chosen).cast("int").alias("one"))


def _sound(grids: DataFrame) -> DataFrame:
    """grids; a size, share or range that cannot be is an error."""
    bad = ~F.coalesce(F.expr("m > 0 and share between 0 and 1 and low > 0 and low <= high"), F.lit(False))
    return grids.withColumn("m", F.when(bad, F.raise_error(F.concat(F.lit("no such grid: "), F.coalesce(F.col("plan_id").cast("string"), F.lit("null"))))).otherwise(F.col("m")))
