"""The library's queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import candidates, classes, model, mosaic, raster, solve
from gridloom.plans import cover_sql as cs
from gridloom.plans import fixtures as fx
from gridloom.plans.cover import Cover

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_PART_SQL: dict[str, str] = {}


def query(sql: str | None = None, part: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and its oracle if it has one. SQL that states less than the whole job is
    given as part: it is no oracle, and tests compare it on small fixtures."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        if part:
            _PART_SQL[f.__name__] = part
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each plan the cheapest single zone that covers all its loads."""
    return x02_best_n1(spark, sf_dir)


def queries() -> dict[str, Query]:
    from gridloom.plans import drawing_queries, fit_queries, layout_queries, mosaic_queries, partition_queries, quantise_queries, request_queries, result_queries, ring_queries, shape_queries, source_queries, state_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def part_sql() -> dict[str, str]:
    queries()
    return dict(_PART_SQL)


def _c(spark: SparkSession, sf_dir: str, boxes: str = fx.BOXES12) -> Cover:
    return Cover.of(spark, sf_dir, boxes)


@query(f"with {cs.raster(fx.BOXES60)} select plan_id, iy, ix, load from raw")
def g09_rasterize(spark, sf_dir):
    return _c(spark, sf_dir, fx.BOXES60).raw


@query(f"with {cs.compact(fx.BOXES60)} select plan_id, iy, ix, load from grid")
def g09_compact(spark, sf_dir):
    return _c(spark, sf_dir, fx.BOXES60).loads


@query(f"with {cs.compact(fx.BOXES60)} select 'x' as axis, plan_id, i, lo, hi from ex union all select 'y', plan_id, i, lo, hi from ey")
def g09_edges(spark, sf_dir):
    c = _c(spark, sf_dir, fx.BOXES60)
    return c.x.select(F.lit("x").alias("axis"), "*").unionByName(c.y.select(F.lit("y").alias("axis"), "*"))


@query(f"with {cs.raster(fx.BOXES60)} select plan_id, iy, ix, coalesce(cast(load as double), 'nan'::double) as load from raw")
def g10_load_matrix(spark, sf_dir):
    return raster.load_matrix(fx.view(spark, sf_dir, fx.BOXES60))


@query(
    f"""with b as ({fx.BOXES60}), l as (select distinct plan_id, x0 as v from b union select plan_id, x1 from b), m as (select distinct plan_id, y0 as v from b union select plan_id, y1 from b),
    x as (select plan_id, v as lo, lead(v) over (partition by plan_id order by v) as hi from l), y as (select plan_id, v as lo, lead(v) over (partition by plan_id order by v) as hi from m),
    o as (select x.plan_id, x.lo as xl, x.hi as xh, y.lo as yl, y.hi as yh, arg_min(b.poly_id, -b.load * 1000000 + b.poly_id) as poly_id from x join y on x.plan_id = y.plan_id
      join b on b.plan_id = x.plan_id and b.x0 <= x.lo and b.x1 >= x.hi and b.y0 <= y.lo and b.y1 >= y.hi where x.hi is not null and y.hi is not null group by all)
    select plan_id, poly_id, cast(sum((xh - xl) * (yh - yl)) as bigint) as area from o group by plan_id, poly_id"""
)
def g07_resolve_overlaps(spark, sf_dir):
    return raster.resolved(fx.view(spark, sf_dir, fx.BOXES60))


def _shifted(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({c: F.col(c) + F.pmod(F.col("poly_id"), F.lit(3)) * 100 for c in ("x0", "x1")})


@query(
    f"""with b as ({fx.BOXES12}), s as (select plan_id, poly_id, x0 + (poly_id % 3) * 100 as x0, y0, x1 + (poly_id % 3) * 100 as x1, y1, load from b), u as (select * from b union all select * from s),
    x as (select plan_id, v as lo, lead(v) over (partition by plan_id order by v) as hi from (select plan_id, x0 as v from u union select plan_id, x1 from u)),
    y as (select plan_id, v as lo, lead(v) over (partition by plan_id order by v) as hi from (select plan_id, y0 as v from u union select plan_id, y1 from u)),
    c as (select x.plan_id, (x.hi - x.lo) * (y.hi - y.lo) as area,
      (select max(load) from b where b.plan_id = x.plan_id and b.x0 <= x.lo and b.x1 >= x.hi and b.y0 <= y.lo and b.y1 >= y.hi) as p,
      (select max(load) from s where s.plan_id = x.plan_id and s.x0 <= x.lo and s.x1 >= x.hi and s.y0 <= y.lo and s.y1 >= y.hi) as q from x join y on x.plan_id = y.plan_id where x.hi is not null and y.hi is not null),
    l as (select plan_id, p as load from c where p is not null union select plan_id, q from c where q is not null)
    select l.plan_id, l.load, cast(coalesce(sum(area) filter (p = l.load), 0) as bigint) as area, cast(coalesce(sum(area) filter (p = l.load and q is distinct from l.load), 0) as bigint) as lost,
      cast(coalesce(sum(area) filter (q = l.load and p is distinct from l.load), 0) as bigint) as gained from l join c on c.plan_id = l.plan_id group by l.plan_id, l.load"""
)
def g11_distortion(spark, sf_dir):
    boxes = fx.view(spark, sf_dir, fx.BOXES12)
    return raster.distortion(boxes, _shifted(boxes))


@query(f"with {cs.compact(fx.BOXES12)} select plan_id, case when plan_id % 2 = 0 then ix else iy end as iy, case when plan_id % 2 = 0 then iy else ix end as ix, load from grid")
def g12_orient(spark, sf_dir):
    return raster.oriented(_c(spark, sf_dir).loads, F.when(F.col("plan_id") % 2 == 0, "X").otherwise("y"))


@query(
    f"with {cs.rectangles(fx.BOXES12)} select c.plan_id, cand_id, a.lo as wx0, s.lo as wy0, e.hi as wx1, t.hi as wy1 from cand c join ex a on a.plan_id = c.plan_id and a.i = c.x0 join ex e on e.plan_id = c.plan_id and e.i = c.x1 "
    "join ey s on s.plan_id = c.plan_id and s.i = c.y0 join ey t on t.plan_id = c.plan_id and t.i = c.y1"
)
def g14_world_rectangles(spark, sf_dir):
    c = _c(spark, sf_dir)
    return raster.to_world(c.listed, c.x, c.y).select("plan_id", "cand_id", "wx0", "wy0", "wx1", "wy1")


@query(f"with stock as ({fx.STOCK}) select stock_id, diameter, step, round(10 * power(diameter / 2.0, 2) * pi() / step, 1) as density from stock")
def c01_bar_density(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.STOCK).withColumn("density", classes.bar_density(F.col("diameter"), F.col("step")).cast("double"))


@query(f"with b as ({fx.BOXES12}), {cs.CLASSES} select array_to_string(combo, '-') as combo, len, cast(value as double) - 8.5 as value from variants")
def c02_multisets(spark, sf_dir):
    return classes.multisets(fx.view(spark, sf_dir, fx.STOCK), fx.MAX_LAYERS).select(F.concat_ws("-", "combo").alias("combo"), "len", F.col("value").cast("double").alias("value"))


@query(
    f"with b as ({fx.BOXES12}), {cs.CLASSES} select plan_id, cls, array_to_string(combo, '-') as combo, len, cast(value as double) as value, cast(density as double) as density, diameter, step from classes"
)
def c03_build_classes(spark, sf_dir):
    return _c(spark, sf_dir).catalogue[0].withColumn("combo", F.concat_ws("-", "combo"))


@query(f"with {cs.classed(fx.BOXES12)} select plan_id, iy, ix, cls from cell")
def c04_loads_to_classes(spark, sf_dir):
    return _c(spark, sf_dir).cells


@query(f"with b as ({fx.BOXES12}), {cs.CLASSES} select l.plan_id, l.cls, array_to_string(layers, ',') as layers, hold from layers l join holds h on h.plan_id = l.plan_id and h.cls = l.cls")
def c06_class_layers(spark, sf_dir):
    c = _c(spark, sf_dir)
    return c.layers.join(c.holds, ["plan_id", "cls"]).withColumn("layers", F.concat_ws(",", "layers"))


@query(f"with {cs.model(fx.BOXES12)} select plan_id, cls, threshold, need from needs")
def c07_thresholds(spark, sf_dir):
    return classes.thresholds(_c(spark, sf_dir).layers)


@query(f"with {cs.rectangles(fx.BOXES12)} select plan_id, x0, y0, x1, y1, cls from rect")
def r02_rectangles(spark, sf_dir):
    return _c(spark, sf_dir).rectangles


@query(f"with {cs.rectangles(fx.BOXES12)} select plan_id, cand_id, x0, y0, x1, y1, cls from cand")
def r02_candidates(spark, sf_dir):
    return _c(spark, sf_dir).listed.select("plan_id", "cand_id", "x0", "y0", "x1", "y1", "cls")


@query(
    "with s as (select p_partkey as plan_id, p_size % 7 + 1 as n from part), a as (select plan_id, n, unnest(generate_series(0, n - 1)) as start from s) "
    "select plan_id, start, unnest(generate_series(1, n - start)) as len from a"
)
def r04_consecutive_subsets(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("plan_id"), (F.col("p_size") % 7 + 1).alias("n"))
    return candidates.consecutive_subsets(parts)


@query(f"with {cs.model(fx.BOXES12)} select plan_id, cand_id, base_area, area, hold, density, cost from priced")
def p01_metrics(spark, sf_dir):
    return _c(spark, sf_dir).valued.select("plan_id", "cand_id", "base_area", "area", "hold", "density", "cost")


@query(f"with {cs.model(fx.BOXES12)} select plan_id, row_id, iy, ix, threshold, need from need_row")
def p02_cover_rows(spark, sf_dir):
    return _c(spark, sf_dir).rows


@query(part=f"with {cs.model(fx.BOXES6)} select plan_id, cand_id, row_id from cov")
def p03_incidence(spark, sf_dir):
    return _c(spark, sf_dir, fx.ALL6).covers.select("plan_id", "cand_id", "row_id")


@query(f"with {cs.model(fx.BOXES12)} select plan_id, round(quantile_cont(cost, 0.5), 4) as scale from priced where cost > 0 group by plan_id")
def p06_objective_scale(spark, sf_dir):
    return model.objective_scale(_c(spark, sf_dir).valued)


_DOMINANCE = """, sig as (select p.plan_id, p.cand_id, p.cost, b.ub, (select coalesce(string_agg(row_id, ',' order by row_id), '') from cov v where v.plan_id = p.plan_id and v.cand_id = p.cand_id) as s
  from priced p join bound b on b.plan_id = p.plan_id and b.cand_id = p.cand_id)"""


@query(
    part=f"with {cs.model(fx.BOXES6)}{_DOMINANCE} select plan_id, cand_id, cost, ub, row_number() over w as rank, coalesce(sum(ub) over (w rows between unbounded preceding and 1 preceding), 0) < 3 as kept "
    "from sig window w as (partition by plan_id, s order by cost, cand_id)"
)
def p08_dominance(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return model.dominance(c.priced, c.covers, 3).drop("signature")


@query(
    part=f"with {cs.model(fx.BOXES6)} select r.plan_id, r.row_id, r.need, cast(coalesce(sum(b.ub), 0) as bigint) as capacity, coalesce(sum(b.ub), 0) >= r.need as enough from need_row r "
    "left join cov v on v.plan_id = r.plan_id and v.row_id = r.row_id left join bound b on b.plan_id = v.plan_id and b.cand_id = v.cand_id group by r.plan_id, r.row_id, r.need"
)
def p08_row_capacity(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return model.row_capacity(c.rows, c.covers, c.bounds)


@query(f"with {cs.model(fx.BOXES12)} select * from single")
def x02_best_n1(spark, sf_dir):
    c = _c(spark, sf_dir)
    return model.best_single(c.valued, c.rows)


_PAIR = """, pair as (
  select a.plan_id, a.cand_id as i, b.cand_id as j, round(a.cost + b.cost, 1) as cost from priced a join priced b on a.plan_id = b.plan_id and a.cand_id <= b.cand_id
  join bound u on u.plan_id = a.plan_id and u.cand_id = a.cand_id where a.cand_id < b.cand_id or u.ub >= 2),
good as (select p.* from pair p join total t on t.plan_id = p.plan_id where t.worst <= 2
  and (select count(distinct row_id) from cov v where v.plan_id = p.plan_id and v.cand_id in (p.i, p.j)) = t.n_rows
  and (select count(*) from cov v join cov w on w.plan_id = v.plan_id and w.row_id = v.row_id where v.plan_id = p.plan_id and v.cand_id = p.i and w.cand_id = p.j and v.need = 2) = t.n_twice)"""


@query(
    part=f"with {cs.model(fx.BOXES6)}{_PAIR} select t.plan_id, t.n_rows, g.i is not null as feasible, g.i as cand_a, g.j as cand_b, g.cost from total t left join "
    "(select plan_id, arg_min(i, {'c': cost, 'i': i, 'j': j}) as i, arg_min(j, {'c': cost, 'i': i, 'j': j}) as j, min(cost) as cost from good group by plan_id) g on g.plan_id = t.plan_id"
)
def x02_best_n2(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return model.best_pair(c.priced, c.rows, c.covers)


def _chosen(c: Cover) -> DataFrame:
    """A solution to work on: every third candidate of the first dozen, once, and one of them twice."""
    return c.candidates.where("cand_id % 3 = 0 and cand_id < 12").select("plan_id", "cand_id", F.when(F.col("cand_id") == 3, 2).otherwise(1).cast("long").alias("copies"))


_CHOSEN = ", chosen as (select plan_id, cand_id, case when cand_id = 3 then 2 else 1 end as copies from cand where cand_id % 3 = 0 and cand_id < 12)"


@query(
    part=f"with {cs.model(fx.BOXES6)}{_CHOSEN}, s as (select r.plan_id, r.row_id, r.need, coalesce(sum(c.copies), 0) as supply from need_row r left join cov v on v.plan_id = r.plan_id and v.row_id = r.row_id "
    "left join chosen c on c.plan_id = v.plan_id and c.cand_id = v.cand_id where r.plan_id in (select plan_id from chosen) group by all) "
    "select plan_id, bool_and(supply >= need) as ok, count(*) filter (supply < need) as lacking from s group by plan_id"
)
def p11_verify(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return model.verified(c.rows, c.covers, _chosen(c))


@query(
    part=f"with {cs.model(fx.BOXES6)}{_CHOSEN}, h as (select plan_id, sum(copies) as have from chosen group by plan_id), "
    "r as (select p.plan_id, p.cand_id, p.cost, coalesce(c.copies, 0) as copies, have, greatest(b.ub - coalesce(c.copies, 0), 0) as spare from priced p join bound b on b.plan_id = p.plan_id and b.cand_id = p.cand_id "
    "join h on h.plan_id = p.plan_id left join chosen c on c.plan_id = p.plan_id and c.cand_id = p.cand_id), "
    "a as (select *, least(spare, greatest(9 - have - coalesce(sum(spare) over (partition by plan_id order by cost, cand_id rows between unbounded preceding and 1 preceding), 0), 0)) as added from r) "
    "select plan_id, cand_id, cast(copies + added as bigint) as copies, cast(added as bigint) as added from a where copies + added > 0"
)
def p12_extend(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return model.extended(c.priced, c.bounds, _chosen(c), 9)


@query(
    part=f"with {cs.model(fx.BOXES6)}{_CHOSEN} select c.plan_id, cast(sum(copies) as bigint) as zones, count(*) as distinct_zones, cast(sum(copies * base_area) as bigint) as base_area, cast(sum(copies * area) as bigint) as area, "
    "round(sum(copies * cost), 1) as total_cost from chosen c join priced p on p.plan_id = c.plan_id and p.cand_id = c.cand_id group by c.plan_id"
)
def p13_materialize(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return model.materialised(c.priced, _chosen(c))


@query(
    part=f"with {cs.model(fx.BOXES6)}{_PAIR} select t.plan_id, 2 as n, case when g.cost is null then 'infeasible' else 'optimal' end as status, g.cost from total t left join (select plan_id, min(cost) as cost from good group by plan_id) g on g.plan_id = t.plan_id"
)
def x01_solve_n2(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return solve.solved(c.bounds, c.rows, c.covers, c.priced, [2]).select("plan_id", "n", "status", F.round("cost", 1).alias("cost"))


@query()
def x01_solve_n3(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return solve.solved(c.bounds, c.rows, c.covers, c.priced, [3]).select("plan_id", "n", "status", F.round("cost", 1).alias("cost"), F.concat_ws(",", "zones").alias("zones"))


def _sides(c: Cover) -> DataFrame:
    return c.candidates.select("plan_id", "x0", "y0", "x1", "y1")


_SIDES = """, sides_of as (select plan_id, x0, y0, x1, y1 from cand where cand_id % 5 = 0),
side as (select plan_id, 'x' as side, unnest(generate_series(y0, y1)) as iy, x0 - 1 as ix from sides_of union all select plan_id, 'x', unnest(generate_series(y0, y1)), x1 from sides_of
  union all select plan_id, 'y', y0 - 1, unnest(generate_series(x0, x1)) from sides_of union all select plan_id, 'y', y1, unnest(generate_series(x0, x1)) from sides_of)"""


@query(part=f"with {cs.rectangles(fx.BOXES6)}{_SIDES} select plan_id, side, iy, ix, count(*) as support from side group by all")
def m01_boundary_support(spark, sf_dir):
    return mosaic.boundary_support(_sides(_c(spark, sf_dir, fx.ALL6)))


@query(
    part=f"with recursive {cs.rectangles(fx.BOXES6).lstrip()}{_SIDES}, cl as (select plan_id, iy, ix, cls from cell where cls > 0), "
    "one as (select a.plan_id, a.iy, a.ix, b.iy as jy, b.ix as jx from cl a join cl b on a.plan_id = b.plan_id and a.cls = b.cls and ((b.ix = a.ix + 1 and b.iy = a.iy) or (b.ix = a.ix and b.iy = a.iy + 1)) "
    "where not exists (select 1 from side s where s.plan_id = a.plan_id and s.iy = a.iy and s.ix = a.ix and s.side = case when b.iy = a.iy then 'x' else 'y' end)), "
    "step as (select * from one union all select plan_id, jy, jx, iy, ix from one), "
    "reach as (select plan_id, iy, ix, iy as ry, ix as rx from cl union select r.plan_id, r.iy, r.ix, s.jy, s.jx from reach r join step s on s.plan_id = r.plan_id and s.iy = r.ry and s.ix = r.rx) "
    "select plan_id, iy, ix, min(ry * 1048576 + rx) as label from reach group by plan_id, iy, ix"
)
def m01_mosaic(spark, sf_dir):
    c = _c(spark, sf_dir, fx.ALL6)
    return mosaic.mosaic(c.cells, _sides(c))
