"""The cover model of a plan: metrics, cover rows, incidence, dominance, and solutions of one or two rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import by_plan, looked_up


def metrics(cands: DataFrame, x: DataFrame, y: DataFrame, classes: DataFrame, holds: DataFrame) -> DataFrame:
    """cands with base_area, area (longer by the hold at both ends along y, inside the grid), density and cost."""
    got = cands.join(by_plan(x, "i", x_lo="lo", x_hi="hi"), "plan_id").join(by_plan(y, "i", y_lo="lo", y_hi="hi"), "plan_id")
    got = got.join(by_plan(classes.where("len = 1"), "cls", densities="density"), "plan_id").join(by_plan(holds, "cls", held="hold"), "plan_id")
    got = got.withColumns({"y_low": F.array_min(F.map_values("y_lo")), "y_high": F.array_max(F.map_values("y_hi"))})
    at = lambda m, place: F.try_element_at(m, F.col(place))
    got = looked_up(got, xl=at("x_lo", "x0"), xh=at("x_hi", "x1"), yl=at("y_lo", "y0"), yh=at("y_hi", "y1"), density=at("densities", "cls"), hold=at("held", "cls"))
    width = F.col("xh") - F.col("xl")
    long = F.least(F.col("y_high"), F.col("yh") + F.col("hold")) - F.greatest(F.col("y_low"), F.col("yl") - F.col("hold"))
    out = got.select(*cands.columns, (width * (F.col("yh") - F.col("yl"))).alias("base_area"), (width * long).alias("area"), "hold", "density")
    return out.withColumn("cost", F.round(F.col("area") * F.col("density"), 1))


def cover_rows(cells: DataFrame, needs: DataFrame) -> DataFrame:
    """What every cell with a class needs: plan_id, row_id, iy, ix, threshold, need."""
    wants = needs.groupBy("plan_id", "cls").agg(F.collect_list(F.struct("threshold", "need")).alias("wants"))
    rows = cells.where("cls > 0").join(by_plan(wants, "cls", by_class="wants"), "plan_id")
    rows = rows.select("plan_id", "iy", "ix", F.inline(F.try_element_at("by_class", F.col("cls"))))
    order = Window.partitionBy("plan_id").orderBy("iy", "ix", "threshold")
    return rows.withColumn("row_id", (F.row_number().over(order) - 1).cast("long"))


def incidence(cands: DataFrame, rows: DataFrame) -> DataFrame:
    """Which candidate covers which row: it holds the cell and its class is the threshold or more."""
    inside = "c.plan_id = r.plan_id and r.ix between c.x0 and c.x1 and r.iy between c.y0 and c.y1 and r.threshold <= c.cls"
    return cands.alias("c").join(rows.alias("r"), F.expr(inside)).select("c.plan_id", "c.cand_id", "r.row_id", "r.need")


def row_candidates(covers: DataFrame) -> DataFrame:
    """The candidates of each row that any covers: plan_id, row_id, cand_ids in order. A row's list is as long as its plan has
    candidates at most."""
    return covers.groupBy("plan_id", "row_id").agg(F.array_sort(F.collect_set("cand_id")).alias("cand_ids"))


def subset(covers: DataFrame, selected: DataFrame) -> DataFrame:
    """The incidence of selected (plan_id, cand_id) alone, numbered anew from 0 in order of cand_id: plan_id, local_id, cand_id,
    row_id. A candidate that covers nothing takes a number and has no row; repeated ones take one."""
    order = Window.partitionBy("plan_id").orderBy("cand_id")
    numbered = selected.select("plan_id", "cand_id").distinct().withColumn("local_id", (F.row_number().over(order) - 1).cast("long"))
    return covers.select("plan_id", "cand_id", "row_id").join(numbered, ["plan_id", "cand_id"]).select("plan_id", "local_id", "cand_id", "row_id")


def upper_bounds(cands: DataFrame, covers: DataFrame) -> DataFrame:
    """Useful copies of each candidate: the largest need it helps with, one at least."""
    most = covers.groupBy("plan_id", "cand_id").agg(F.max("need").alias("ub"))
    return cands.join(most, ["plan_id", "cand_id"], "left").withColumn("ub", F.greatest(F.coalesce("ub", F.lit(0)), F.lit(1)))


def dominance(priced: DataFrame, covers: DataFrame, max_n: int) -> DataFrame:
    """Candidates with their group of equal covered rows, their rank in it by cost, and whether max_n copies can need them."""
    signature = covers.groupBy("plan_id", "cand_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("row_id"))).alias("signature"))
    rows = upper_bounds(priced, covers).join(signature, ["plan_id", "cand_id"], "left").withColumn("signature", F.coalesce("signature", F.lit("")))
    order = Window.partitionBy("plan_id", "signature").orderBy("cost", "cand_id")
    before = F.coalesce(F.sum("ub").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("plan_id", "cand_id", "cost", "ub", "signature", F.row_number().over(order).alias("rank"), (before < max_n).alias("kept"))


def row_capacity(rows: DataFrame, covers: DataFrame, bounds: DataFrame) -> DataFrame:
    """What all candidates together can give each row, and whether it is enough."""
    got = covers.join(bounds.select("plan_id", "cand_id", "ub"), ["plan_id", "cand_id"]).groupBy("plan_id", "row_id").agg(F.sum("ub").alias("capacity"))
    return rows.join(got, ["plan_id", "row_id"], "left").select("plan_id", "row_id", "need", F.coalesce("capacity", F.lit(0)).alias("capacity"), (F.coalesce("capacity", F.lit(0)) >= F.col("need")).alias("enough"))


def objective_scale(priced: DataFrame) -> DataFrame:
    """The median of each plan's positive costs."""
    return priced.where("cost > 0").groupBy("plan_id").agg(F.round(F.percentile("cost", 0.5), 4).alias("scale"))


def best_single(priced: DataFrame, rows: DataFrame) -> DataFrame:
    """For each plan the cheapest candidate that covers all its rows alone, null where none does: one that holds the hull of their
    cells and whose class is the highest threshold or more, where no row needs two."""
    hull = [F.min("ix").alias("left"), F.max("ix").alias("right"), F.min("iy").alias("first"), F.max("iy").alias("last"), F.max("threshold").alias("highest"), F.max("need").alias("most")]
    wanted = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_rows"), *hull)
    full = priced.join(wanted, "plan_id").where("most = 1 and x0 <= left and x1 >= right and y0 <= first and y1 >= last and cls >= highest")
    best = full.groupBy("plan_id").agg(F.min(F.struct("cost", "cand_id")).alias("best"))
    return wanted.join(best, "plan_id", "left").select("plan_id", "n_rows", F.col("best").isNotNull().alias("feasible"), F.col("best.cand_id").alias("cand_id"), F.col("best.cost").alias("cost"))


def best_pair(priced: DataFrame, rows: DataFrame, covers: DataFrame) -> DataFrame:
    """For each plan the cheapest two candidates, or two copies of one, that give every row its need.

    Pairs are of one plan's candidates, whose number the plan's grid bounds."""
    wanted = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("need") > 2, 1).otherwise(0)).alias("hopeless"))
    sets = covers.groupBy("plan_id", "cand_id").agg(F.collect_list("row_id").alias("rows"), F.collect_list(F.when(F.col("need") == 2, F.col("row_id"))).alias("twice"))
    sets = upper_bounds(priced, covers).join(sets, ["plan_id", "cand_id"]).select("plan_id", "cand_id", "cost", "ub", "rows", "twice")
    doubles = rows.where("need = 2").groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_twice"))
    b = sets.select("plan_id", *(F.col(c).alias(f"{c}2") for c in ("cand_id", "cost", "rows", "twice")))
    pairs = sets.join(b, "plan_id").where("cand_id < cand_id2 or (cand_id = cand_id2 and ub >= 2)").join(wanted.where("hopeless = 0"), "plan_id").join(doubles, "plan_id", "left")
    good = pairs.where((F.size(F.array_union("rows", "rows2")) == F.col("n_rows")) & (F.size(F.array_intersect("twice", "twice2")) == F.coalesce("n_twice", F.lit(0))))
    best = good.groupBy("plan_id").agg(F.min(F.struct(F.round(F.col("cost") + F.col("cost2"), 1).alias("cost"), F.col("cand_id").alias("a"), F.col("cand_id2").alias("b"))).alias("best"))
    return wanted.join(best, "plan_id", "left").select("plan_id", "n_rows", F.col("best").isNotNull().alias("feasible"), F.col("best.a").alias("cand_a"), F.col("best.b").alias("cand_b"), F.col("best.cost").alias("cost"))


def supply(rows: DataFrame, covers: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each row what chosen (plan_id, cand_id, copies) gives it and whether that is its need."""
    got = covers.join(chosen, ["plan_id", "cand_id"]).groupBy("plan_id", "row_id").agg(F.sum("copies").alias("supply"))
    plans = chosen.select("plan_id").distinct()
    return rows.join(plans, "plan_id", "left_semi").join(got, ["plan_id", "row_id"], "left").select("plan_id", "row_id", "need", F.coalesce("supply", F.lit(0)).alias("supply"))


def verified(rows: DataFrame, covers: DataFrame, chosen: DataFrame) -> DataFrame:
    """Whether chosen gives every row of each of its plans its need, and how many rows lack something."""
    return supply(rows, covers, chosen).groupBy("plan_id").agg(F.bool_and(F.col("supply") >= F.col("need")).alias("ok"), F.sum(F.when(F.col("supply") < F.col("need"), 1).otherwise(0)).alias("lacking"))


def extended(priced: DataFrame, bounds: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """chosen with the cheapest spare copies added, in order of cost and id, until each plan has n: plan_id, cand_id, copies, added."""
    have = chosen.groupBy("plan_id").agg(F.sum("copies").alias("have"))
    rows = priced.join(bounds.select("plan_id", "cand_id", "ub"), ["plan_id", "cand_id"]).join(have, "plan_id").join(chosen, ["plan_id", "cand_id"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    spare = F.greatest(F.col("ub") - F.col("copies"), F.lit(0))
    before = F.coalesce(F.sum(spare).over(Window.partitionBy("plan_id").orderBy("cost", "cand_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("added", F.least(spare, F.greatest(F.lit(n) - F.col("have") - before, F.lit(0))))
    return rows.where("copies + added > 0").select("plan_id", "cand_id", (F.col("copies") + F.col("added")).cast("long").alias("copies"), F.col("added").cast("long").alias("added"))


def materialised(priced: DataFrame, chosen: DataFrame) -> DataFrame:
    """Totals of each plan's solution: zones, distinct, base_area, area, total_cost."""
    got = chosen.join(priced, ["plan_id", "cand_id"])
    return got.groupBy("plan_id").agg(F.sum("copies").alias("zones"), F.count(F.lit(1)).alias("distinct_zones"), F.sum(F.col("copies") * F.col("base_area")).alias("base_area"), F.sum(F.col("copies") * F.col("area")).alias("area"), F.round(F.sum(F.col("copies") * F.col("cost")), 1).alias("total_cost"))


def checked_counts(rows: DataFrame, covers: DataFrame, bounds: DataFrame, chosen: DataFrame, asked: DataFrame) -> DataFrame:
    """For each plan of asked (plan_id, n) whether its chosen copies are n in number, each of a known candidate and within its
    bound, and give every row its need: plan_id, n, in_bounds, right_count, supplied, ok.

    A null n asks for no number. A plan without chosen copies supplies nothing. Copies of a candidate in several rows add up."""
    copies = chosen.groupBy("plan_id", "cand_id").agg(F.sum("copies").alias("copies"), F.min("copies").alias("least"))
    held = copies.join(bounds.select("plan_id", "cand_id", "ub"), ["plan_id", "cand_id"], "left")
    fine = F.coalesce((F.col("least") >= 0) & (F.col("copies") <= F.col("ub")), F.lit(False))
    held = held.groupBy("plan_id").agg(F.bool_and(fine).alias("in_bounds"), F.sum("copies").alias("have"))
    got = covers.join(copies, ["plan_id", "cand_id"]).groupBy("plan_id", "row_id").agg(F.sum("copies").alias("supply"))
    short = rows.join(got, ["plan_id", "row_id"], "left").where("coalesce(supply, 0) < need").select("plan_id").distinct().withColumn("short", F.lit(True))
    out = asked.join(held, "plan_id", "left").join(short, "plan_id", "left")
    right = F.col("n").isNull() | (F.coalesce("have", F.lit(0)) == F.col("n"))
    out = out.select("plan_id", "n", F.coalesce("in_bounds", F.lit(True)).alias("in_bounds"), right.alias("right_count"), F.col("short").isNull().alias("supplied"))
    return out.withColumn("ok", F.expr("in_bounds and right_count and supplied"))


def uncovered_cells(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those cells (plan_id, iy, ix) that no chosen rectangle (plan_id, x0, y0, x1, y1) holds."""
    inside = "c.plan_id = r.plan_id and c.ix between r.x0 and r.x1 and c.iy between r.y0 and r.y1"
    return cells.alias("c").join(chosen.alias("r"), F.expr(inside), "left_anti")


def problem_ids(cells: DataFrame, x: DataFrame, y: DataFrame, cands: DataFrame, classes: DataFrame, holds: DataFrame, recipes: DataFrame, axis: str | None = None, zeros: bool = False) -> DataFrame:
    """A name for each plan's cover problem: plan_id, problem_id, the SHA-256 of its cells, edges, candidates, densities, holds,
    recipes and options in a form of their own.

    Equal problems have equal names, in whatever order their rows come. Numbers that are not whole count to six digits. A
    table's rows are hashed in groups of one row or column first, so no list holds more than a group or its hashes."""

    def digest(df: DataFrame, name: str, group: str, *columns: str) -> DataFrame:
        text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
        inner = df.groupBy("plan_id", F.col(group).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ";"), 256).alias("h"))
        return inner.groupBy("plan_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias(name))

    def exact(df: DataFrame, c: str) -> DataFrame:
        return df.withColumn(c, F.col(c).cast("decimal(28,6)"))

    edges = lambda e, name: digest(exact(exact(e, "lo"), "hi"), name, "i", "i", "lo", "hi")
    parts = [digest(cells, "cells", "iy", "iy", "ix", "cls"), edges(x, "x"), edges(y, "y"), digest(cands, "cands", "x0", "x0", "y0", "x1", "y1", "cls"), digest(exact(classes.where("density is not null"), "density"), "densities", "cls", "cls", "density"),
             digest(exact(holds, "hold"), "holds", "cls", "cls", "hold"), digest(recipes.withColumn("layers", F.array_join(F.array_sort("layers"), "+")), "recipes", "cls", "cls", "layers")]
    names = ("cells", "x", "y", "cands", "densities", "holds", "recipes")
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "plan_id", "left")
    whole = F.concat_ws("|", *(F.coalesce(F.col(n), F.lit("-")) for n in names), F.lit(axis or ""), F.lit("1" if zeros else "0"))
    return out.select("plan_id", F.sha2(whole, 256).alias("problem_id"))
