"""Queries of result rows, checks of solutions, mosaics and fields, and made grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import layout, model, mosaic, raster, results, rings
from gridloom.plans import cover_sql as cs
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.plans.cover import Cover
from gridloom.plans.layout_queries import ZONES
from gridloom.session import held

#: What solvers left of each order: flags and sources, many of them left out.
RESULTS = """select o_orderkey as job_id, case o_orderkey % 4 when 0 then true when 1 then false when 2 then true end as is_feasible, o_orderkey % 8 = 0 as is_optimal, o_orderkey % 12 = 1 as infeasibility_proved, o_orderkey % 10 = 4 as cache_hit,
 case when o_orderkey % 13 = 0 then 'hard_timeout' end as termination_reason, case when o_orderkey % 13 = 0 then true end as time_limit_reached, cast(case when o_orderkey % 17 = 0 then false end as boolean) as has_incumbent,
 case o_orderkey % 19 when 0 then 'solver' when 1 then 'cache' end as incumbent_source, cast(case when o_orderkey % 23 = 0 then true end as boolean) as incumbent_is_solver_best, cast(case when o_orderkey % 29 = 0 then true end as boolean) as solver_incumbent_recovered,
 case o_custkey % 3 when 0 then 'solver' when 1 then 'warm_start' end as source from orders"""
_ENDED = """job_id, is_feasible, is_optimal, infeasibility_proved, cache_hit, coalesce(termination_reason, case when is_optimal then 'optimal' when infeasibility_proved then 'infeasible' when is_feasible then 'solver_stopped' else 'no_solution' end) as termination_reason,
 coalesce(time_limit_reached, false) as time_limit_reached, coalesce(has_incumbent, is_feasible, false) as has_incumbent"""
_R = f"with r as ({RESULTS})"


@query(f"""{_R}, s as (select *, case when incumbent_source is null and is_feasible and not cache_hit then 'solver' else incumbent_source end as given from r)
 select {_ENDED}, given as incumbent_source, coalesce(incumbent_is_solver_best, is_feasible and given = 'solver', false) as incumbent_is_solver_best from s""")
def x18_defaults(spark, sf_dir):
    return results.with_defaults(fx.view(spark, sf_dir, RESULTS)).drop("source", "solver_incumbent_recovered")


@query(f"""{_R} select {_ENDED}, coalesce(incumbent_source, case when is_feasible then source end) as incumbent_source, coalesce(incumbent_is_solver_best, is_feasible and source = 'solver', false) as incumbent_is_solver_best,
 coalesce(solver_incumbent_recovered, is_feasible and source = 'solver', false) as solver_incumbent_recovered from r""")
def h21_job_defaults(spark, sf_dir):
    return results.with_job_defaults(fx.view(spark, sf_dir, RESULTS), "source").drop("source")


_ASKED = "select o_orderkey as plan_id, cast(o_custkey % 40 as bigint) as n, case o_orderkey % 3 when 0 then '' when 1 then 'rows short' end as reason, o_orderkey % 5 = 0 as proved from orders"
_NONE = "cast(null as double) as total_cost, cast(null as double) as total_area, cast(null as double) as total_base_area, cast(null as bigint) as n_rectangles, n as n_requested, false as is_feasible, false as is_optimal, false as solver_proved_optimal, false as has_incumbent, cast(null as varchar) as incumbent_source"


@query(f"select plan_id, {_NONE}, 'Infeasible' as status, proved as infeasibility_proved, reason, case when proved then 'infeasible' else 'no_solution' end as termination_reason, false as time_limit_reached from ({_ASKED})")
def x19_empty_results(spark, sf_dir):
    return results.unsolved(fx.view(spark, sf_dir, _ASKED), F.lit("Infeasible"), F.col("reason"), F.col("proved"))


@query(f"select plan_id, {_NONE}, 'HardTimeout' as status, false as infeasibility_proved, 'stopped at the hard time limit without an incumbent' as reason, 'hard_timeout' as termination_reason, true as time_limit_reached from ({_ASKED})")
def j16_timeouts(spark, sf_dir):
    return results.timed_out(fx.view(spark, sf_dir, _ASKED))


@query(f"select plan_id, {_NONE}, 'Infeasible' as status, true as infeasibility_proved, case when reason <> '' then reason else 'proved infeasible before' end as reason, 'infeasible' as termination_reason, false as time_limit_reached from ({_ASKED})")
def h18_known_infeasible(spark, sf_dir):
    return results.known_infeasible(fx.view(spark, sf_dir, _ASKED))


_PICKS = "select cast(floor(l_partkey / 12) as bigint) as plan_id, l_partkey as cand_id from lineitem"


@query(f"select p.plan_id, p.cand_id, p.copies, b.x0, b.y0, b.x1, b.y1 from (select plan_id, cand_id, count(*) as copies from ({_PICKS}) group by all) p join ({fx.BOXES12}) b on b.plan_id = p.plan_id and b.poly_id = p.cand_id")
def x16_multiplicities(spark, sf_dir):
    return results.multiplicities(fx.view(spark, sf_dir, _PICKS), fx.view(spark, sf_dir, fx.BOXES12).withColumnRenamed("poly_id", "cand_id"))


#: A stored solution of each plan, one in 40 to 340 of its candidates, some of them twice; plans with an odd id ask for one more.
_COPIES = "case when cand_id % 11 = 10 then 2 else 1 end"
_TAKEN = "cand_id % (40 + plan_id % 300) = 0"
_STORED = f", stored as (select plan_id, cand_id, {_COPIES} as copies from cand where {_TAKEN}), wish as (select plan_id, sum(copies) + plan_id % 2 as n from stored group by plan_id)"
_CHECKED = f"""{_STORED}, sup as (select r.plan_id, r.row_id, r.need, coalesce(sum(s.copies), 0) as supply from need_row r left join (select c.plan_id, c.row_id, s.copies from cov c join stored s on s.plan_id = c.plan_id and s.cand_id = c.cand_id) s on s.plan_id = r.plan_id and s.row_id = r.row_id group by all),
checked as (select w.plan_id, cast(w.n as bigint) as n, i.in_bounds, w.plan_id % 2 = 0 as right_count, coalesce(u.supplied, true) as supplied from wish w join (select s.plan_id, bool_and(s.copies <= b.ub) as in_bounds from stored s join bound b on b.plan_id = s.plan_id and b.cand_id = s.cand_id group by s.plan_id) i on i.plan_id = w.plan_id
 left join (select plan_id, bool_and(supply >= need) as supplied from sup group by plan_id) u on u.plan_id = w.plan_id)"""


def _checked(spark, sf_dir):
    c = Cover.of(spark, sf_dir)
    taken = held(c.listed.where(_TAKEN))
    covers = model.incidence(taken, c.rows)
    stored = taken.selectExpr("plan_id", "cand_id", f"{_COPIES} as copies")
    asked = stored.groupBy("plan_id").agg(F.sum("copies").alias("n")).withColumn("n", F.expr("n + plan_id % 2"))
    return model.checked_counts(c.rows, covers, model.upper_bounds(taken, covers), stored, asked)


@query(f"with {cs.model(fx.BOXES12)} select plan_id, cand_id, ub from bound")
def j10_copies_limit(spark, sf_dir):
    return Cover.of(spark, sf_dir).bounds.select("plan_id", "cand_id", "ub")


@query(f"with {cs.model(fx.BOXES12)}{_CHECKED} select *, in_bounds and right_count and supplied as ok from checked")
def p14_checked_counts(spark, sf_dir):
    return _checked(spark, sf_dir)


@query(f"with {cs.model(fx.BOXES12)}{_CHECKED} select plan_id, n, true as optimal from checked where in_bounds and right_count and supplied and plan_id % 3 <> 0")
def j13_cached_optimal(spark, sf_dir):
    checked = _checked(spark, sf_dir)
    entries = checked.selectExpr("plan_id", "n", "plan_id % 3 <> 0 as optimal")
    return results.cached_optimal(entries, checked)


#: Cells where boxes begin, and boxes as rectangles of cells.
_CELLS = f"select distinct plan_id, cast(floor(y0 / 500) as int) as iy, cast(floor(x0 / 500) as int) as ix from ({fx.BOXES12}) as b"
_RECTS = f"select plan_id, poly_id as rect_id, cast(floor(x0 / 500) as int) as x0, cast(floor(y0 / 500) as int) as y0, cast(floor(x1 / 500) as int) as x1, cast(floor(y1 / 500) as int) as y1 from ({fx.BOXES12}) as b"


@query(f"with c as ({_CELLS}), r as ({_RECTS}) select * from c where not exists (select 1 from r where r.rect_id % 4 = 0 and r.plan_id = c.plan_id and c.ix between r.x0 and r.x1 and c.iy between r.y0 and r.y1)")
def x14_uncovered(spark, sf_dir):
    return model.uncovered_cells(fx.view(spark, sf_dir, _CELLS), fx.view(spark, sf_dir, _RECTS).where("rect_id % 4 = 0"))


_UNITS = f"select plan_id, iy, ix, cast(floor(iy / 5) * 100 + floor(ix / 6) as bigint) as unit from ({_CELLS}) as c"


@query(f"with u as ({_UNITS}), r as ({_RECTS}) select r.plan_id, r.rect_id, u.unit, count(*) < (select count(*) from u as w where w.plan_id = r.plan_id and w.unit = u.unit) as cut from u join r on r.plan_id = u.plan_id and u.ix between r.x0 and r.x1 and u.iy between r.y0 and r.y1 group by r.plan_id, r.rect_id, u.unit")
def m04_units_inside(spark, sf_dir):
    return mosaic.units_inside(fx.view(spark, sf_dir, _UNITS), fx.view(spark, sf_dir, _RECTS))


#: Labels of plans of three rows of four; one plan in five lacks a cell, one has a cell twice, one is not finite, one is not whole.
_LABELS = """select * from (select cast(floor(p_partkey / 12) as bigint) as plan_id, cast(floor(p_partkey % 12 / 4) as int) as iy, cast(p_partkey % 4 as int) as ix, p_partkey % 12 as place,
 case when floor(p_partkey / 12) % 5 = 2 and p_partkey % 12 = 7 then cast('Infinity' as double) when floor(p_partkey / 12) % 5 = 3 and p_partkey % 12 = 3 then 2.5 else cast(p_size as double) end as label from part) as l
 where not (plan_id % 5 = 1 and place = 5)"""
_PLACED = "select plan_id, iy, case when plan_id % 5 = 4 and place = 2 then 1 else ix end as ix, label from"


@query(f"select plan_id, case when count(*) <> 12 or count(distinct iy * 4 + ix) <> 12 then 'shape' when bool_or(isinf(label)) then 'finite' when bool_or(label <> floor(label)) then 'integer' end as problem from ({_PLACED} ({_LABELS}) as k) as l group by plan_id")
def m02_label_problems(spark, sf_dir):
    labels = fx.view(spark, sf_dir, f"{_PLACED} ({_LABELS}) as k")
    return mosaic.label_problem(labels, labels.select("plan_id").distinct().selectExpr("plan_id", "3 as ny", "4 as nx"))


_NEXT = ", ".join(f"lead({c}) over w as {c}n" for c in ("x0", "x1", "y0", "y1"))


@query(f"""with z as (select *, {_NEXT} from ({ZONES}) as q window w as (partition by plan_id order by zone_id)) select plan_id, zone_id, case when x0n is not null then greatest(0, least(x1, x1n) - greatest(x0, x0n)) end as across,
 case when x0n is not null then greatest(0, least(y1, y1n) - greatest(y0, y0n)) end as along, case when x0n is not null then greatest(0, least(x1, x1n) - greatest(x0, x0n)) * greatest(0, least(y1, y1n) - greatest(y0, y0n)) end as area from z""")
def l16_overlaps(spark, sf_dir):
    z = fx.view(spark, sf_dir, f"select *, {_NEXT} from ({ZONES}) as q window w as (partition by plan_id order by zone_id)")
    across, along = (layout.overlap(*(F.col(c) for c in (f"{a}0", f"{a}1", f"{a}0n", f"{a}1n"))) for a in "xy")
    return z.select("plan_id", "zone_id", across.alias("across"), along.alias("along"), (across * along).alias("area"))


_FIELD = f"select plan_id, cast(ix * 500 as bigint) as x0, cast(iy * 500 as bigint) as y0, cast(ix * 500 + 500 as bigint) as x1, cast(iy * 500 + 500 as bigint) as y1 from ({_CELLS}) as c"
_BARS = f"select plan_id, poly_id as zone_id, x0 + poly_id % 2 * 100 as x0, y0, x0 + 400 + poly_id % 3 * 100 as x1, y0 + 500 + poly_id % 5 * 100 as y1 from ({fx.BOXES12}) as b"


@query(f"with f as ({_FIELD}), z as ({_BARS}) select z.plan_id, z.zone_id, coalesce(sum((least(z.x1, f.x1) - greatest(z.x0, f.x0)) * (least(z.y1, f.y1) - greatest(z.y0, f.y0))), 0) = any_value((z.x1 - z.x0) * (z.y1 - z.y0)) as inside from z left join f on f.plan_id = z.plan_id and z.x0 < f.x1 and f.x0 < z.x1 and z.y0 < f.y1 and f.y0 < z.y1 group by z.plan_id, z.zone_id")
def l33_inside_field(spark, sf_dir):
    return layout.inside_field(fx.view(spark, sf_dir, _BARS), fx.view(spark, sf_dir, _FIELD))


_GRIDS = "select p_partkey as plan_id, cast(1 + p_size % 6 as int) as m, cast(p_partkey % 5 as double) / 5 as share, cast(0.5 as double) as low, cast(2 as double) as high, p_partkey * 31 as seed from part"
_U = lambda *parts: "(cast('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8) as bigint) / 4294967296.0::double)"


@query(f"with g as ({_GRIDS}), a as (select *, unnest(['x', 'y']) as axis from g), s as (select *, unnest(generate_series(0, m - 1)) as i from a) select plan_id, axis, i, round(low + (high - low) * {_U('seed', 'axis', 'i')}, 3) as size from s")
def s22_random_sizes(spark, sf_dir):
    return raster.random_sizes(fx.view(spark, sf_dir, _GRIDS))


@query(
    f"with g as ({_GRIDS}), a as (select *, unnest(generate_series(0, m - 1)) as iy from g), s as (select *, unnest(generate_series(0, m - 1)) as ix from a), o as (select *, cast({_U('seed', 'iy', 'ix')} < share as int) as one from s) "
    f"select plan_id, iy, ix, case when max(one) over (partition by plan_id) = 0 and iy = floor({_U('seed', chr(39) + 'row' + chr(39))} * m) and ix = floor({_U('seed', chr(39) + 'column' + chr(39))} * m) then 1 else one end as one from o"
)
def s22_random_mask(spark, sf_dir):
    return raster.random_mask(fx.view(spark, sf_dir, _GRIDS))


_P = lambda k: f"[[[{k},0],[{k},5],[9,5]]]"
#: A geometry of each kind; k is the part's size.
_SHAPES = {
    0: '{"type":"Polygon","coordinates":' + _P("@") + "}",
    1: '{"type":"MultiPolygon","coordinates":[' + _P("@") + "," + _P("1") + "]}",
    2: '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"Polygon","coordinates":' + _P("2") + '},{"type":"MultiPolygon","coordinates":[' + _P("@") + "," + _P("3") + "]}]}",
    3: '{"type":"LineString","coordinates":[[1,2],[3,4]]}',
    4: '{"type":"Polygon","coordinates":[]}',
    5: "{",
}
_GEOMETRIES = "select p_partkey as poly_id, p_size, replace(case p_partkey % 7 " + " ".join(f"when {k} then '{v}'" for k, v in _SHAPES.items()) + " end, '@', cast(p_size as string)) as geometry from part"


@query("select poly_id, unnest(range(len(firsts))) as pos, cast(unnest(firsts) as double) as first_x, 3 as points from (select p_partkey as poly_id, case p_partkey % 7 when 0 then [p_size] when 1 then [p_size, 1] when 2 then [2, p_size, 3] end as firsts from part where p_partkey % 7 < 3)")
def g02_flat_polygons(spark, sf_dir):
    flat = rings.flat_polygons(fx.view(spark, sf_dir, _GEOMETRIES))
    return flat.select("poly_id", "pos", F.expr("rings[0][0][0]").alias("first_x"), F.size(F.expr("rings[0]")).alias("points"))
