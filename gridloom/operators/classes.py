"""The catalogue of layered classes, and loads as classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import by_plan


def bar_density(diameter: Column, step: Column) -> Column:
    """Steel of bars of a diameter at a step, to one decimal."""
    return F.round(10 * F.pow(diameter / 2, F.lit(2)) * F.pi() / step, 1).cast("decimal(10,1)")


def multisets(stock: DataFrame, most: int) -> DataFrame:
    """Index multisets of up to most stock entries: combo, len and the summed density."""
    one = stock.select(F.col("stock_id").alias("s"), bar_density(F.col("diameter"), F.col("step")).alias("arm"))
    out = stock.sparkSession.range(1).select(F.expr("cast(array() as array<int>)").alias("combo"), F.lit(0).cast("decimal(10,1)").alias("value"))
    level = out
    for _ in range(most):
        grown = level.join(one, F.coalesce(F.try_element_at("combo", F.lit(-1)) <= F.col("s"), F.lit(True)))
        level = grown.select(F.concat("combo", F.array("s")).alias("combo"), (F.col("value") + F.col("arm")).cast("decimal(10,1)").alias("value"))
        out = out.unionByName(level)
    return out.withColumn("len", F.size("combo"))


def build_classes(loads: DataFrame, stock: DataFrame, back: tuple[int, int], most: int) -> tuple[DataFrame, DataFrame]:
    """Classes of each plan, and the class of each of its loads (plan_id, load).

    A load takes the first variant, by value, length and combination, whose value is above it. The stock and its
    multisets are a fixed small table, the same for all plans."""
    base = bar_density(F.lit(back[0]), F.lit(back[1]))
    variants = F.broadcast(multisets(stock, most).select((F.col("value") + base).cast("decimal(10,1)").alias("value"), "len", "combo"))
    chosen = loads.join(variants, F.col("value") > F.col("load")).groupBy("plan_id", "load").agg(F.min(F.struct("value", "len", "combo")).alias("v"))
    kept = chosen.select("plan_id", F.explode(F.concat(F.array(F.col("v.combo"), F.expr("cast(array() as array<int>)")), F.transform("v.combo", lambda s: F.array(s)))).alias("combo")).distinct()
    rows = kept.join(variants, "combo").withColumn("cls", F.row_number().over(Window.partitionBy("plan_id").orderBy("value", "len", "combo")) - 1)
    s = F.broadcast(stock.select(F.array("stock_id").alias("combo"), "diameter", "step", bar_density(F.col("diameter"), F.col("step")).cast("double").alias("density")))
    classes = rows.join(s, "combo", "left").select("plan_id", "cls", "combo", "len", F.col("value").cast("double").alias("value"), "density", "diameter", "step")
    load_classes = chosen.select("plan_id", "load", F.col("v.combo").alias("combo")).join(rows.select("plan_id", "combo", "cls"), ["plan_id", "combo"]).select("plan_id", "load", "cls")
    return classes, load_classes


def class_layers(classes: DataFrame) -> DataFrame:
    """The base classes that each class but the background consists of: plan_id, cls, layers (sorted)."""
    parts = classes.where("len > 0").select("plan_id", "cls", F.explode("combo").alias("s"))
    base = classes.where("len = 1").select("plan_id", F.get("combo", F.lit(0)).alias("s"), F.col("cls").alias("b"))
    return parts.join(base, ["plan_id", "s"]).groupBy("plan_id", "cls").agg(F.array_sort(F.collect_list("b")).alias("layers"))


def class_holds(classes: DataFrame, factor: int) -> DataFrame:
    """The anchorage of each class, the longest of its layers: plan_id, cls, hold."""
    d = classes.where("len = 1").select("plan_id", F.get("combo", F.lit(0)).alias("s"), (factor * F.col("diameter")).cast("long").alias("hold"))
    return classes.where("len > 0").select("plan_id", "cls", F.explode("combo").alias("s")).join(d, ["plan_id", "s"]).groupBy("plan_id", "cls").agg(F.max("hold").alias("hold"))


def thresholds(layers: DataFrame) -> DataFrame:
    """For each class the layers t that it needs and how many of its layers are t or more: plan_id, cls, threshold, need."""
    each = layers.select("plan_id", "cls", "layers", F.explode(F.array_distinct("layers")).alias("threshold"))
    return each.select("plan_id", "cls", "threshold", F.size(F.filter("layers", lambda v: v >= F.col("threshold"))).alias("need"))


def loads_to_classes(cells: DataFrame, load_classes: DataFrame) -> DataFrame:
    """Cells with their class; load 0 and none are the background; a load that has no class is an error of that row."""
    known = by_plan(load_classes.where("load is not null"), "load", known="cls")
    got = cells.join(known, "plan_id", "left").withColumn("c", F.try_element_at("known", F.col("load")))
    cls = F.when(F.coalesce("load", F.lit(0)) == 0, F.lit(0)).when(F.col("c").isNull(), F.raise_error(F.lit("a load has no class")).cast("int")).otherwise(F.col("c"))
    return got.select("plan_id", "iy", "ix", cls.alias("cls"))
