"""Queries of rings, index rectangles, class checks and stored solutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import rings, solutions
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query

#: A ring of each part: a box with points on its sides, every third one with a slanted corner.
_RING = """select p_partkey as poly_id, p_size as s, case when p_partkey % 3 = 0 then 1 else 0 end as cut from part"""
_POINTS = [("0", "0"), ("s", "0"), ("2 * s", "0"), ("2 * s", "s"), ("2 * s", "2 * s"), ("s", "2 * s + cut"), ("0", "2 * s"), ("0", "s")]


def _rings(spark, sf_dir):
    r = fx.view(spark, sf_dir, _RING)
    return r.select("poly_id", F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in _POINTS)).alias("ring"))


def _shown(ring):
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), ",")


_RING_SQL = f"with r as ({_RING}), p as (" + " union all ".join(f"select poly_id, {i} as k, {x} as x, {y} as y from r" for i, (x, y) in enumerate(_POINTS)) + (
    "), q as (select a.*, b.x as px, b.y as py, c.x as nx, c.y as ny from p a join p b on a.poly_id = b.poly_id and b.k = (a.k + 7) % 8 join p c on a.poly_id = c.poly_id and c.k = (a.k + 1) % 8) select poly_id, string_agg(x || ' ' || y, ',' order by k) as ring from q where "
)


@query(_RING_SQL + "(x - px) * (ny - y) <> (y - py) * (nx - x) group by poly_id")
def g03_straight_points(spark, sf_dir):
    return _rings(spark, sf_dir).select("poly_id", _shown(rings.without_straight_points(F.col("ring"))).alias("ring"))


@query(_RING_SQL + "not (px = x and x = nx) and not (py = y and y = ny) group by poly_id")
def g05_axis_points(spark, sf_dir):
    return _rings(spark, sf_dir).select("poly_id", _shown(rings.without_axis_points(F.col("ring"))).alias("ring"))


_AXES = "select o_orderkey as job_id, case o_orderkey % 6 when 0 then ' X' when 1 then 'y ' when 2 then '1' when 3 then '0' when 4 then 'z' end as axis from orders"


@query(f"select job_id, case job_id % 6 when 0 then 'x' when 1 then 'y' when 2 then 'x' when 3 then 'y' end as axis from ({_AXES})")
def g16_axis_names(spark, sf_dir):
    return fx.view(spark, sf_dir, _AXES).select("job_id", rings.axis_name(F.col("axis")).alias("axis"))


@query(f"select plan_id, poly_id, y0 as x0, x0 as y0, y1 as x1, x1 as y1 from ({fx.BOXES12})")
def g13_restored(spark, sf_dir):
    return rings.restored(fx.view(spark, sf_dir, fx.BOXES12).select("plan_id", "poly_id", "x0", "y0", "x1", "y1"), "x")


_CELLS = f"select plan_id, poly_id as rect_id, cast(x0 / 500 as bigint) as x0, cast(y0 / 500 as bigint) as y0, cast(x1 / 500 as bigint) as x1, cast(y1 / 500 as bigint) as y1 from ({fx.BOXES12}) as b"


@query(
    f"with r as ({_CELLS}), w as (select plan_id, k, sum(50.0 + (plan_id + k) % 7 * 10) over (partition by plan_id order by k) as e from (select distinct plan_id from r) cross join (select unnest(generate_series(0, 13)) as k)), e as (select plan_id, k + 1 as k, cast(e as double) as e from w union all select distinct plan_id, 0, 0.0 from r) "
    "select r.plan_id, rect_id, a.e as x0, b.e as y0, c.e as x1, d.e as y1 from r left join e a on a.plan_id = r.plan_id and a.k = r.x0 left join e b on b.plan_id = r.plan_id and b.k = r.y0 left join e c on c.plan_id = r.plan_id and c.k = r.x1 + 1 left join e d on d.plan_id = r.plan_id and d.k = r.y1 + 1"
)
def g15_by_widths(spark, sf_dir):
    r = fx.view(spark, sf_dir, _CELLS)
    widths = r.select("plan_id").distinct().select("plan_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis"), F.transform(F.sequence(F.lit(0), F.lit(13)), lambda k: (50.0 + (F.col("plan_id") + k) % 7 * 10)).alias("widths"))
    return rings.by_widths(r, widths)


_RECIPES = "select cast(floor(p_partkey / 10) as bigint) as plan_id, case when p_partkey % 10 = 9 then -1 else p_partkey % 10 end as cls, p_size % 12 as a, p_partkey % 5 as b, p_partkey % 10 = 8 as none from part"


@query(
    f"with r as ({_RECIPES}) select plan_id, cls, case when none then '' when a <= b then a || ',' || b else b || ',' || a end as layers, case when cls < 0 then 'class' when none then 'empty' when a > 8 then 'layer' end as problem from r"
)
def c05_recipes(spark, sf_dir):
    r = fx.view(spark, sf_dir, _RECIPES)
    layers = F.when(F.col("none"), F.array().cast("array<int>")).otherwise(F.array(F.col("a").cast("int"), F.col("b").cast("int")))
    classes = r.select("plan_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("cls")).distinct()
    return rings.recipe_problems(r.select("plan_id", "cls", layers.alias("layers")), classes).withColumn("layers", F.array_join("layers", ","))


@query(
    "with p as (select cast(floor(p_partkey / 10) as bigint) as plan_id, p_partkey % 10 as cls, p_size from part) select plan_id, cls, case when cls in (3) and p_size % 4 = 0 then 'missing' when cls = 0 then 'class' when p_size % 9 = 0 then 'value' when cls >= 8 then 'unknown' end as problem from p where (cls = 3 and p_size % 4 = 0) or cls = 0 or p_size % 9 = 0 or cls >= 8"
)
def c09_holds(spark, sf_dir):
    """Classes 0 to 7 are known; holds are given for all parts but some of class 3."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(floor(p_partkey / 10) as bigint) as plan_id", "p_partkey % 10 as cls", "p_size")
    hold = F.when(F.col("p_size") % 9 == 0, F.when(F.col("p_size") % 2 == 0, float("nan")).otherwise(-1.0)).otherwise(F.col("p_size") * 1.0)
    return rings.hold_problems(p.where("cls < 8").select("plan_id", "cls"), p.where("not (cls = 3 and p_size % 4 = 0)").select("plan_id", "cls", hold.alias("hold")))


_ENTRIES = """select cast(l_orderkey % 50 as bigint) as plan_id, cast(l_linenumber as bigint) as n, l_orderkey * 8 + l_linenumber as pos, l_orderkey % 11 as k, l_linestatus = 'F' as optimal, cast(l_quantity as int) as q,
 case when l_orderkey % 11 = 0 then concat('{"cost":', cast(l_quantity as int), '}') when l_orderkey % 11 = 1 then concat('{"indices":[3,1],"total_cost":', cast(l_quantity as int), '}') when l_orderkey % 11 = 2 then '{"indices":[4,"x"],"cost":1}' when l_orderkey % 11 = 3 then '{"indices":[9,2],"cost":"NaN"}'
 when l_orderkey % 11 = 4 then '{"indices":["3",1.7,2.0],"cost":null,"total_cost":5,"v":1,"optimal":true}' when l_orderkey % 11 = 5 then '{"indices":[7],"cost":"2.5","v":"1","optimal":true}' when l_orderkey % 11 = 6 then concat('{"indices":[5],"total_cost":', cast(l_quantity as int), ',"v":1.0,"is_optimal":1}')
 else concat('{"indices":[', cast(l_quantity as int), ',2],"cost":', cast(l_quantity as int), ',"v":', 1 + l_orderkey % 2, ',"optimal":', case when l_linestatus = 'F' then 'true' else 'false' end, '}') end as raw from lineitem"""
_BEST = f"""with e as (select *, case when k in (3, 4) then null when k = 5 then 2.5 else cast(q as double) end as cost, k in (4, 6) or (k > 6 and optimal and ((pos - n) // 8) % 2 = 0) as best, case k when 1 then '1,3' when 3 then '2,9' when 4 then '1,2,3' when 5 then '7' when 6 then '5' else least(q, 2) || ',' || greatest(q, 2) end as indices from ({_ENTRIES}) where k not in (0, 2)),
b as (select * from e qualify row_number() over (partition by plan_id, n order by not best, coalesce(cost, 'inf'::double), pos) = 1)"""


@query(f"{_BEST} select plan_id, n, indices, cost, best as optimal from b")
def j05_best_entries(spark, sf_dir):
    return solutions.best_entries(fx.view(spark, sf_dir, _ENTRIES)).withColumn("indices", F.array_join("indices", ","))


_DATA = "select plan_id, case when plan_id % 5 = 0 then 2 when plan_id % 5 = 1 then null else 3 end as version, case when plan_id % 7 = 0 then 'other' when plan_id % 7 = 1 then null else 'mine' end as problem_id, 'mine' as asked from (select distinct cast(l_orderkey % 50 as bigint) as plan_id from lineitem) as t"


@query(
    f"{_BEST}, d as ({_DATA}), f as (select d.plan_id, i.n from d join (values (2), (6), (9)) i(n) on true where version = 3 and coalesce(problem_id, 'mine') = 'mine') "
    "select b.plan_id, b.n, 'solved' as status, cost, best as optimal, null as problem from b join d on d.plan_id = b.plan_id and coalesce(problem_id, 'mine') = 'mine' where (b.plan_id, b.n) not in (select (plan_id, n) from f) "
    "union all select plan_id, n, 'infeasible', null, null, null from f union all select plan_id, null, null, null, null, 'problem_id' from d where problem_id = 'other'"
)
def j04_migrated(spark, sf_dir):
    plans = fx.view(spark, sf_dir, _DATA)
    proved = plans.select("plan_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (2, 6, 9)))).alias("n"))
    return solutions.migrated(fx.view(spark, sf_dir, _ENTRIES), plans, proved)


_RESULTS = "select cast(l_orderkey % 50 as bigint) as plan_id, cast(l_linenumber as bigint) as n, l_orderkey * 8 + l_linenumber as seq, l_orderkey % 3 > 0 as feasible, l_linestatus = 'F' and l_orderkey % 4 = 1 as optimal, cast(l_quantity as double) as cost, l_orderkey % 23 = 0 as proved from lineitem"


@query(
    f"with r as ({_RESULTS}), s as (select *, max(case when proved then seq end) over (partition by plan_id, n) as proof from r), k as (select plan_id, n, proof, min(case when feasible and (proof is null or seq > proof) then {{'o': not optimal, 'c': cost, 's': seq}} end) as b from s group by all) "
    "select plan_id, n, case when b is null then 'infeasible' when b.o then 'feasible' else 'optimal' end as status, b.s as seq, b.c as cost from k where b is not null or proof is not null"
)
def j08_registered(spark, sf_dir):
    return solutions.registered(fx.view(spark, sf_dir, _RESULTS))
