"""Candidate rectangles: runs with bridged gaps over every span of columns, expanded to base classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import by_plan, looked_up


def bridged_runs(profiles: DataFrame, keys: list[str], edges: DataFrame, holds: DataFrame) -> DataFrame:
    """Runs of one class along iy in profiles (plan_id, keys, iy, cls > 0): keys, run, y0, y1, cls.

    A run goes on over empty cells if the next cell has its class and the gap is no longer than the class's hold."""
    order = Window.partitionBy("plan_id", *keys).orderBy("iy")
    rows = profiles.join(by_plan(edges, "i", los="lo", his="hi"), "plan_id").join(by_plan(holds, "cls", longest="hold"), "plan_id")
    rows = looked_up(rows, lo=F.try_element_at("los", F.col("iy")), hi=F.try_element_at("his", F.col("iy")), hold=F.try_element_at("longest", F.col("cls")))
    rows = rows.select("plan_id", *keys, "iy", "cls", "lo", "hi", "hold")
    rows = rows.withColumn("new", F.coalesce((F.lag("cls").over(order) != F.col("cls")) | (F.col("lo") - F.lag("hi").over(order) > F.col("hold")), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("plan_id", *keys, "run").agg(F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.min("cls").alias("cls"))


def run_spans(runs: DataFrame, keys: list[str]) -> DataFrame:
    """From the start of each run to the end of it or a later one, with the highest class between: keys, y0, y1, cls."""
    on = Window.partitionBy("plan_id", *keys).orderBy("run").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = F.collect_list(F.struct(F.col("run").alias("run2"), F.col("y1").alias("end"), F.col("cls").alias("cls2"))).over(on)
    both = runs.withColumn("later", later).select("plan_id", *keys, "run", "y0", F.inline("later"))
    w = Window.partitionBy("plan_id", *keys, "run").orderBy("run2")
    return both.select("plan_id", *keys, "y0", F.col("end").alias("y1"), F.max("cls2").over(w).alias("cls"))


def all_rectangles(cells: DataFrame, x: DataFrame, y: DataFrame, holds: DataFrame, min_width: int) -> DataFrame:
    """Rectangles (plan_id, x0, y0, x1, y1, cls) over cells (plan_id, iy, ix, cls); x and y are edges."""
    full = cells.where("cls > 0")
    active = full.select("plan_id", F.col("ix").alias("i")).distinct().join(x, ["plan_id", "i"])
    left = active.select("plan_id", F.col("i").alias("x0"), F.col("lo").alias("from"))
    right = active.select("plan_id", F.col("i").alias("x1"), F.col("hi").alias("to"))
    spans = left.join(right, "plan_id").where((F.col("x1") >= F.col("x0")) & (F.col("to") - F.col("from") >= min_width)).select("plan_id", "x0", "x1")
    profile = spans.join(full, "plan_id").where("ix between x0 and x1").groupBy("plan_id", "x0", "x1", "iy").agg(F.max("cls").alias("cls"))
    found = run_spans(bridged_runs(profile, ["x0", "x1"], y, holds), ["x0", "x1"])
    columns = by_plan(full.groupBy("plan_id", "ix").agg(F.collect_list("iy").alias("rows")), "ix", columns="rows")
    touches = lambda side: F.exists(F.try_element_at("columns", F.col(side)), lambda r: r.between(F.col("y0"), F.col("y1")))
    return found.join(columns, "plan_id").where(touches("x0") | touches("x1")).select("plan_id", "x0", "y0", "x1", "y1", "cls")


def expanded(rects: DataFrame, layers: DataFrame) -> DataFrame:
    """Rectangles of base classes, each once, with cand_id, their place in the plan's sorted list."""
    flat = rects.join(by_plan(layers.withColumn("bases", F.array_distinct("layers")), "cls", bases="bases"), "plan_id")
    flat = flat.select("plan_id", "x0", "y0", "x1", "y1", F.explode(F.try_element_at("bases", F.col("cls"))).alias("cls"))
    place = ("x0", "y0", "x1", "y1", "cls")
    order, same = Window.partitionBy("plan_id").orderBy(*place), Window.partitionBy("plan_id", *place).orderBy("plan_id")
    ranked = flat.withColumn("cand_id", (F.dense_rank().over(order) - 1).cast("long"))
    return ranked.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")


def consecutive_subsets(sizes: DataFrame) -> DataFrame:
    """All stretches (start, len) of n in a row, for each row (plan_id, n)."""
    start = sizes.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return start.select("plan_id", "start", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("start"))).alias("len"))
