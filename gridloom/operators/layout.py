"""Bars and zones: positions, phases, spacing, merging, depth, coverage and steel.

Zones are (plan_id, zone_id, cls, x0, y0, x1, y1, step, hold, diameter); bars run along y at their x. Joins between bars
have plan_id and a bin of x as keys, each bar standing in its own bin and the next, so close pairs always meet. They are merge joins by hint, for
Spark takes bars for as few as the zones that they are made from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(zones: DataFrame, unit: int) -> DataFrame:
    """Zones in whole units: low sides rounded down, high sides up."""
    down, up = (lambda c: F.floor(F.col(c) / unit).cast("long")), (lambda c: F.ceil(F.col(c) / unit).cast("long"))
    return zones.select("plan_id", "zone_id", down("x0").alias("x0"), down("y0").alias("y0"), up("x1").alias("x1"), up("y1").alias("y1"))


def fitted_width(required: Column, least: Column, step: Column) -> Column:
    """The least multiple of step that is at least 1, the least width and what is required."""
    return F.ceil(F.greatest(F.lit(1), least, required) / step) * step


def fitted_interval(old0: Column, old1: Column, need0: Column, need1: Column, length: Column, low: Column, high: Column) -> Column:
    """The start of an interval of a length that holds need0..need1 within low..high, as near as can be to the middle of
    old0..old1; null where there is none."""
    least, most = F.greatest(low, need1 - length), F.least(high - length, need0)
    can = (length <= high - low) & (need1 - need0 <= length) & (least <= most)
    return F.when(can, F.least(F.greatest((old0 + old1 - length) / 2, least), most))


def profiles(needs: DataFrame) -> DataFrame:
    """What boxes (plan_id, poly_id, layers: the classes their load asks for) need: plan_id, poly_id, threshold, need, the number of
    layers of the threshold's class or a higher one. Boxes without layers need nothing."""
    each = needs.select("plan_id", "poly_id", "layers", F.explode(F.array_distinct("layers")).alias("threshold"))
    return each.select("plan_id", "poly_id", "threshold", F.size(F.filter("layers", lambda c: c >= F.col("threshold"))).alias("need"))


def stages(boxes: DataFrame, needs: DataFrame) -> DataFrame:
    """The order in which needs are met: highest load first, in it the highest threshold: plan_id, stage, load, threshold."""
    each = boxes.where("load > 0").select("plan_id", "poly_id", "load").join(profiles(needs), ["plan_id", "poly_id"]).select("plan_id", "load", "threshold").distinct()
    order = Window.partitionBy("plan_id").orderBy(F.desc("load"), F.desc("threshold"))
    return each.select("plan_id", (F.row_number().over(order) - 1).alias("stage"), "load", "threshold")


def new_classes(needs: DataFrame, classes: DataFrame) -> DataFrame:
    """For each threshold (plan_id, threshold) the class (plan_id, cls, density) of least density that is not below it, of
    equal ones the lowest: plan_id, threshold, cls; null if there is none."""
    met = needs.select("plan_id", "threshold").distinct().join(classes.select("plan_id", "cls", "density"), "plan_id", "left")
    fits = F.col("cls") >= F.col("threshold")
    return met.groupBy("plan_id", "threshold").agg(F.min(F.when(fits, F.struct("density", "cls")))["cls"].alias("cls"))


def _standing(zones: DataFrame) -> DataFrame:
    """Bars with the sides x0 and x1 of their zone."""
    last = F.bround((F.col("x1") - F.col("x0")) / F.col("step")).cast("long")
    bars = zones.withColumn("bar", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return bars.select("plan_id", "zone_id", "cls", "bar", (F.col("x0") + F.col("bar") * F.col("step")).alias("x"), "y0", "y1", "x0", "x1")


def positions(zones: DataFrame) -> DataFrame:
    """A bar at each step from a zone's left side to the step nearest to its right one: plan_id, zone_id, cls, bar, x, y0, y1."""
    return _standing(zones).drop("x0", "x1")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative numbers below 2**62."""
    start = F.struct(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step)["a"]


def quantum(a: Column, b: Column, gap: int) -> Column:
    """The smallest divisor of both steps' common divisor that is a gap or more, else that divisor."""
    g = gcd(a, b)
    return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(gap).cast("long"), F.greatest(g, F.lit(gap).cast("long"))), lambda d: (g % d) == 0)), g)


def preferred_phase(a: Column, b: Column, module: Column, gap: int) -> Column:
    """How far bars at step a should stand from bars at step b."""
    big, small = F.greatest(a, b), F.least(a, b)
    g = gcd(a, b)
    double = F.when(small / 3 >= gap, big / 3).otherwise(small / 2)
    return F.when(a == b, F.when(a == module, a / 2).otherwise(0.0)).when(big % small == 0, F.when(big == 2 * small, double).otherwise(0.0)).otherwise(F.when(g >= 2 * gap, g / 2).otherwise(0.0))


def cyclic_distance(x: Column, y: Column, m: Column) -> Column:
    d = F.pmod(x - y, m)
    return F.least(d, m - d)


def close_pairs(zones: DataFrame, gap: int) -> DataFrame:
    """For every two zones that run side by side their nearest two bars, of those at different places within the width that the
    zones share, where these are nearer than gap: plan_id, a and b (zones, the smaller first), distance, xa, xb, y0, y1.
    Of equally near pairs the one at the least place."""
    bars = _standing(zones).withColumn("bin", F.floor(F.col("x") / gap)).drop("cls", "bar")
    right = bars.select("plan_id", *(F.col(c).alias(f"{c}_") for c in ("zone_id", "x", "y0", "y1", "x0", "x1")), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    apart = F.abs(F.col("x") - F.col("x_"))
    inside = lambda x: (x >= F.greatest("x0", "x0_")) & (x <= F.least("x1", "x1_"))
    near = (F.col("zone_id") < F.col("zone_id_")) & (F.least("y1", "y1_") > F.greatest("y0", "y0_")) & (apart > 0) & (apart < gap)
    met = bars.join(right.hint("merge"), ["plan_id", "bin"]).where(near & inside(F.col("x")) & inside(F.col("x_")))
    best = F.min(F.struct(apart.alias("distance"), F.col("x").alias("xa"), F.col("x_").alias("xb"), F.greatest("y0", "y0_").alias("y0"), F.least("y1", "y1_").alias("y1"))).alias("k")
    return met.groupBy("plan_id", F.col("zone_id").alias("a"), F.col("zone_id_").alias("b")).agg(best).select("plan_id", "a", "b", "k.*")


def coincident_triples(zones: DataFrame) -> DataFrame:
    """Triples of zones that each have a bar at one place within the width they share, where all three run: plan_id, a, b, c, x, y0, y1."""
    bars = _standing(zones).where("x <= x1")  # a last bar may stand beyond its zone
    first, second, third = (bars.select("plan_id", "x", *(F.col(c).alias(f"{c}{k}") for c in ("zone_id", "y0", "y1"))) for k in (1, 2, 3))
    pairs = first.join(second.hint("merge"), ["plan_id", "x"]).where("zone_id1 < zone_id2 and least(y11, y12) > greatest(y01, y02)")
    met = pairs.join(third.hint("merge"), ["plan_id", "x"]).where("zone_id2 < zone_id3").withColumns({"y0": F.greatest("y01", "y02", "y03"), "y1": F.least("y11", "y12", "y13")})
    return met.where("y1 > y0").select("plan_id", F.col("zone_id1").alias("a"), F.col("zone_id2").alias("b"), F.col("zone_id3").alias("c"), "x", "y0", "y1")


def shared_bars(bars: DataFrame) -> DataFrame:
    """Bars of one class at one place that overlap or touch, as one: plan_id, cls, x, y0, y1, zones."""
    place = ["plan_id", "cls", "x"]
    order = Window.partitionBy(*place).orderBy("y0", "y1", "zone_id", "bar")
    rows = bars.withColumn("reach", F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("piece", F.sum(F.coalesce(F.col("y0") > F.col("reach"), F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*place, "piece").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count_distinct("zone_id").alias("zones")).drop("piece")


def depth(bars: DataFrame) -> DataFrame:
    """The most bars of a place that run side by side: plan_id, x, depth."""
    ends = bars.select("plan_id", "x", F.explode(F.array(F.struct(F.col("y0").alias("y"), F.lit(1).alias("d")), F.struct(F.col("y1").alias("y"), F.lit(-1).alias("d")))).alias("e")).select("plan_id", "x", "e.y", "e.d")
    order = Window.partitionBy("plan_id", "x").orderBy("y", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("open", F.sum("d").over(order)).groupBy("plan_id", "x").agg(F.max("open").alias("depth"))


def coverage(boxes: DataFrame, needs: DataFrame, zones: DataFrame, quantum: Column | float) -> DataFrame:
    """Per box and threshold the zones that may serve it: plan_id, poly_id, threshold, need, options, relaxations, ok.

    A zone of the threshold's class or a higher one serves a box if it spans it along y and misses across no more than its step
    and the quantum. The best need of them, by what is missed beyond the step and then by zone_id, are used; relaxations
    counts those of them that miss more than their step."""
    want = profiles(needs).join(boxes.select("plan_id", "poly_id", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1"))), ["plan_id", "poly_id"])
    z = zones.select("plan_id", "zone_id", "cls", "x0", "y0", "x1", "y1", "step")
    missed = F.greatest(F.lit(0), F.greatest(F.col("x0") - F.col("bx0"), F.col("bx1") - F.col("x1"), F.lit(0)) - F.col("step"))
    serves = (F.col("cls") >= F.col("threshold")) & (F.col("y0") <= F.col("by0")) & (F.col("y1") >= F.col("by1")) & (missed <= quantum)
    met = want.join(z, "plan_id").where(serves).select("plan_id", "poly_id", "threshold", "need", "zone_id", missed.alias("extra"))
    order = Window.partitionBy("plan_id", "poly_id", "threshold").orderBy("extra", "zone_id")
    got = met.withColumn("place", F.row_number().over(order)).groupBy("plan_id", "poly_id", "threshold").agg(
        F.count(F.lit(1)).alias("options"), F.sum(((F.col("place") <= F.col("need")) & (F.col("extra") > 0)).cast("long")).alias("relaxations")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = want.select("plan_id", "poly_id", "threshold", "need").join(got, ["plan_id", "poly_id", "threshold"], "left")
    ok = zero(F.col("options")) >= F.col("need")
    return out.select("plan_id", "poly_id", "threshold", "need", zero(F.col("options")).alias("options"), F.when(ok, zero(F.col("relaxations"))).otherwise(0).alias("relaxations"), ok.alias("ok"))


#: What a threshold misses for which too few zones are there; a fixed value of the score.
NO_ZONE = 10**9


def edge_misses(boxes: DataFrame, needs: DataFrame, zones: DataFrame, fields: DataFrame, exact: bool = False, slack: float = 1e-8) -> DataFrame:
    """How well boxes at the field's sides are held without any relaxation: plan_id, poly_id, threshold, need, covered, best_miss,
    miss_sum.

    fields (plan_id, low, high) are the sides across; a box counts if it reaches one. A zone of the threshold's class, or a higher
    one unless exact, holds a box as far as it spans it along y; what it leaves at the worse side is its miss, covered counts the
    zones that miss nothing. best_miss is the last of the need zones that miss least, null if there are fewer, and miss_sum what
    these miss together, NO_ZONE if there are fewer, 0 where need is met. A plan without a field has no rows."""
    at = boxes.join(fields.select("plan_id", F.col("low").alias("f0"), F.col("high").alias("f1")), "plan_id").where(~((F.col("x0") > F.col("f0") + slack) & (F.col("x1") < F.col("f1") - slack)))
    at = at.select("plan_id", "poly_id", *(F.col(c).cast("double").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    want = profiles(needs).join(at, ["plan_id", "poly_id"])
    own = F.col("cls") == F.col("threshold") if exact else F.col("cls") >= F.col("threshold")
    serves = own & (F.col("y0") <= F.col("by0") + slack) & (F.col("y1") >= F.col("by1") - slack)
    miss = F.greatest(F.lit(0.0), F.col("x0") - F.col("bx0"), F.col("bx1") - F.col("x1"))
    met = want.join(zones.select("plan_id", "zone_id", "cls", "x0", "y0", "x1", "y1"), "plan_id").where(serves).select("plan_id", "poly_id", "threshold", "need", "zone_id", miss.alias("miss"))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("plan_id", "poly_id", "threshold").orderBy("miss", "zone_id")))
    got = met.groupBy("plan_id", "poly_id", "threshold").agg(F.sum((F.col("miss") <= slack).cast("long")).alias("covered"), F.max(F.when(F.col("place") == F.col("need"), F.col("miss"))).alias("best_miss"), F.sum(F.when(F.col("place") <= F.col("need"), F.col("miss"))).alias("some"))
    out = want.select("plan_id", "poly_id", "threshold", "need").join(got, ["plan_id", "poly_id", "threshold"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    summed = F.when(F.col("covered") >= F.col("need"), 0.0).when(F.col("best_miss").isNull(), float(NO_ZONE)).otherwise(F.col("some"))
    return out.select("plan_id", "poly_id", "threshold", "need", "covered", "best_miss", summed.alias("miss_sum"))


def edge_relaxations(misses: DataFrame) -> DataFrame:
    """Those of edge_misses() whose need is not met: plan_id, poly_id, threshold, need, covered, best_miss."""
    return misses.where("covered < need").select("plan_id", "poly_id", "threshold", "need", "covered", "best_miss")


def edge_score(misses: DataFrame) -> DataFrame:
    """Of edge_misses() what each plan lacks: plan_id, lacking (zones), missed (length)."""
    return misses.groupBy("plan_id").agg(F.sum(F.greatest(F.lit(0), F.col("need") - F.col("covered"))).cast("long").alias("lacking"), F.sum("miss_sum").alias("missed"))


def contacts(zones: DataFrame) -> DataFrame:
    """Zones of one class that touch across x, where they also overlap or touch along y: plan_id, a (at the left), b, at."""
    right = zones.select("plan_id", "cls", F.col("x0").alias("at"), *(F.col(c).alias(f"{c}2") for c in ("zone_id", "y0", "y1")))
    met = zones.withColumn("at", F.col("x1")).join(right, ["plan_id", "cls", "at"]).where((F.col("zone_id") != F.col("zone_id2")) & (F.least("y1", "y12") >= F.greatest("y0", "y02")))
    return met.select("plan_id", F.col("zone_id").alias("a"), F.col("zone_id2").alias("b"), "at")


def touch_limits(zones: DataFrame, top: DataFrame) -> DataFrame:
    """How far zones may grow across before what touches them is in the way: plan_id, zone_id, low, high, null without limit.
    Past a contact a zone may go one step, of the highest class (top: plan_id, cls) two."""
    own = zones.join(top.select("plan_id", F.col("cls").alias("top")), "plan_id").select("plan_id", "zone_id", (F.col("step") * F.when(F.col("cls") == F.col("top"), 2).otherwise(1)).alias("reach"))
    met = contacts(zones)
    ends = met.select("plan_id", F.col("a").alias("zone_id"), F.col("at").alias("right"), F.lit(None).cast("long").alias("left")).unionByName(met.select("plan_id", F.col("b").alias("zone_id"), F.lit(None).cast("long").alias("right"), F.col("at").alias("left")))
    got = ends.groupBy("plan_id", "zone_id").agg(F.min("right").alias("right"), F.max("left").alias("left"))
    return own.join(got, ["plan_id", "zone_id"], "left").select("plan_id", "zone_id", (F.col("left") - F.col("reach")).alias("low"), (F.col("right") + F.col("reach")).alias("high"))


def anchorage_pieces(bars: DataFrame) -> DataFrame:
    """What an anchored bar has beyond the bar itself, at both ends: plan_id, zone_id, bar, low, high."""
    pieces = F.array(F.struct(F.col("a0").alias("low"), F.col("y0").alias("high")), F.struct(F.col("y1").alias("low"), F.col("a1").alias("high")))
    return bars.select("plan_id", "zone_id", "bar", F.explode(F.filter(pieces, lambda p: p["high"] > p["low"])).alias("p")).select("plan_id", "zone_id", "bar", "p.low", "p.high")


def steel(zones: DataFrame, fields: DataFrame, density: int) -> DataFrame:
    """Per plan: bars, length and mass without and with anchorage, which ends at the field (plan_id, low, high along y)."""
    bars = positions(zones).join(zones.select("plan_id", "zone_id", "hold", "diameter"), ["plan_id", "zone_id"]).join(fields, "plan_id")
    anchored = F.least("high", F.col("y1") + F.col("hold")) - F.greatest("low", F.col("y0") - F.col("hold"))
    per_mm = density * math.pi * F.pow(F.col("diameter") / 1000, F.lit(2)) / 4 / 1000
    plain = F.col("y1") - F.col("y0")
    return bars.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(plain).alias("length"), F.sum(anchored).alias("anchored_length"),
        F.round(F.sum(plain * per_mm), 3).alias("mass"), F.round(F.sum(anchored * per_mm), 3).alias("anchored_mass"),
    )


def overlap(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """How much two intervals share, 0 where they only touch; null where a bound is."""
    shared = F.when(low.isNotNull() & high.isNotNull() & low2.isNotNull() & high2.isNotNull(), F.least(high, high2) - F.greatest(low, low2))
    return F.when(shared > 0, shared).when(shared.isNotNull(), F.lit(0))


def inside_field(zones: DataFrame, field: DataFrame, slack: float = 1e-7) -> DataFrame:
    """For each zone (plan_id, zone_id, x0, y0, x1, y1) whether the plan's field, disjoint rectangles (plan_id, x0, y0, x1, y1),
    holds it whole, but for a seam of slack around it: plan_id, zone_id, inside. A plan without a field holds none."""
    z = zones.select("plan_id", "zone_id", *(F.col(c).alias(f"z{c}") for c in ("x0", "y0", "x1", "y1"))).distinct()
    meets = "z.plan_id = f.plan_id and z.zx0 < f.x1 and f.x0 < z.zx1 and z.zy0 < f.y1 and f.y0 < z.zy1"
    clip = overlap(F.col("zx0"), F.col("zx1"), F.col("x0"), F.col("x1")) * overlap(F.col("zy0"), F.col("zy1"), F.col("y0"), F.col("y1"))
    held = z.alias("z").join(field.alias("f"), F.expr(meets), "left").groupBy("z.plan_id", "z.zone_id").agg(F.coalesce(F.sum(clip), F.lit(0)).alias("held"), F.first(F.expr("(zx1 - zx0) * (zy1 - zy0)")).alias("area"), F.first(F.expr("2 * (zx1 - zx0 + zy1 - zy0)")).alias("around"))
    return held.select("plan_id", "zone_id", (F.col("held") >= F.col("area") - slack * F.col("around")).alias("inside"))
