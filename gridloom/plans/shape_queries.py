"""Queries of repaired, united and cleaned polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import shapes
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query

#: Rings of parts with side s: a box, a crossed one, one that repeats points and goes back on itself, and a line.
_KINDS = [
    [("0", "0"), ("s", "0"), ("s", "s"), ("0", "s")],
    [("0", "0"), ("s", "0"), ("0", "s"), ("s", "s")],
    [("0", "0"), ("0", "0"), ("s", "0"), ("2 * s", "0"), ("s", "0"), ("s", "2 * s"), ("0", "2 * s"), ("0", "0")],
    [("0", "0"), ("s", "s"), ("0", "0")],
    [("0", "0"), ("3 * s", "0"), ("3 * s", "3 * s"), ("s", "3 * s"), ("s", "s"), ("2 * s", "s"), ("2 * s", "2 * s"), ("0", "2 * s")],
]
_PARTS = "select p_partkey as poly_id, p_size as s from part"


def _rings(spark, sf_dir):
    points = lambda pairs: F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in pairs))
    kind = F.col("poly_id") % 5
    made = F.when(kind == 0, points(_KINDS[0]))
    for k in range(1, 5):
        made = made.when(kind == k, points(_KINDS[k]))
    return fx.view(spark, sf_dir, _PARTS).select("poly_id", made.alias("points"))


#: Areas by kind; the line has none. The last ring crosses itself: 7 s * s is what an odd number of its edges encloses.
_AREA = "case poly_id % 5 when 0 then s * s when 1 then s * s / 2.0 when 2 then 2 * s * s when 4 then 7 * s * s end"


@query(f"select poly_id, cast({_AREA} as double) as area, 0.0::double as x0, 0.0::double as y0, cast(case when poly_id % 5 = 4 then 3 * s else s end as double) as x1, cast(case poly_id % 5 when 2 then 2 * s when 4 then 3 * s else s end as double) as y1 from ({_PARTS}) where poly_id % 5 <> 3")
def g01_repaired(spark, sf_dir):
    keys = ["poly_id"]
    got = shapes.measured(shapes.united(_rings(spark, sf_dir).withColumn("shape", F.lit(0)), keys), keys)
    return got.withColumn("area", F.round("area", 6))


@query(
    f"""with b as ({fx.BOXES60}), l as (select distinct plan_id, load, x0 as v from b union select plan_id, load, x1 from b), m as (select distinct plan_id, load, y0 as v from b union select plan_id, load, y1 from b),
    x as (select plan_id, load, v as lo, lead(v) over (partition by plan_id, load order by v) as hi from l), y as (select plan_id, load, v as lo, lead(v) over (partition by plan_id, load order by v) as hi from m)
    select x.plan_id, x.load, cast(sum((x.hi - x.lo) * (y.hi - y.lo)) as double) as area, cast(min(x.lo) as double) as x0, cast(min(y.lo) as double) as y0, cast(max(x.hi) as double) as x1, cast(max(y.hi) as double) as y1 from x join y on x.plan_id = y.plan_id and x.load = y.load
    where exists (select 1 from b where b.plan_id = x.plan_id and b.load = x.load and b.x0 <= x.lo and b.x1 >= x.hi and b.y0 <= y.lo and b.y1 >= y.hi) group by x.plan_id, x.load"""
)
def h02_united(spark, sf_dir):
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rings = fx.view(spark, sf_dir, fx.BOXES60).select("plan_id", "load", F.col("poly_id").alias("shape"), F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("points"))
    keys = ["plan_id", "load"]
    return shapes.measured(shapes.united(rings, keys), keys)



@query(f"select poly_id, cast(case poly_id % 5 when 2 then 6 when 4 then 8 else 4 end as bigint) as points from ({_PARTS}) where poly_id % 5 <> 3")
def h03_clean_rings(spark, sf_dir):
    got = _rings(spark, sf_dir).select("poly_id", shapes.clean_ring(F.col("points")).alias("ring"))
    return got.where("ring is not null").select("poly_id", F.size("ring").cast("long").alias("points"))


@query(f"select poly_id, cast(case poly_id % 5 when 2 then 4 when 4 then 8 else 4 end as bigint) as points, cast(1 + (poly_id % 2) as bigint) as rings from ({_PARTS}) where poly_id % 5 <> 3")
def g06_clean_polygons(spark, sf_dir):
    hole = F.when(F.col("poly_id") % 2 == 1, F.col("points")).otherwise(F.slice("points", 1, 2))
    got = shapes.clean_polygons(_rings(spark, sf_dir).select("poly_id", F.array("points", hole).alias("rings")))
    return got.select("poly_id", F.size(F.col("rings")[0]).cast("long").alias("points"), F.size("rings").cast("long").alias("rings"))
