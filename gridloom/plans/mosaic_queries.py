"""Queries of mosaic units: cells that no candidate cuts, and the cover model with one row for each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import classes, model, mosaic
from gridloom.plans import cover_sql as cs
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.plans.cover import Cover

#: Labels proposed for the cells of a plan: stripes of four columns.
_LABEL = "cast(floor(ix / 4) as bigint)"


def _units(c: Cover, cands: DataFrame) -> DataFrame:
    cells = c.cells.where("cls > 0").select("plan_id", "iy", "ix", F.expr(_LABEL).alias("label"), F.col("cls").alias("profile"))
    return mosaic.refined(cells, cands)


def _rows(c: Cover) -> DataFrame:
    """What every unit needs, in place of what every cell does."""
    cells = mosaic.unit_rows(_units(c, c.candidates)).select("plan_id", "iy", "ix", F.col("profile").alias("cls"))
    return model.cover_rows(cells, classes.thresholds(c.layers))


def _units_sql(boxes: str) -> str:
    return f"""with recursive {cs.model(boxes).lstrip()},
cl as (select plan_id, iy, ix, cls, {_LABEL} as label from cell where cls > 0),
one as (
  select a.plan_id, a.iy, a.ix, b.iy as jy, b.ix as jx from cl a join cl b on a.plan_id = b.plan_id and a.cls = b.cls and a.label = b.label and b.ix = a.ix + 1 and b.iy = a.iy
  where not exists (select 1 from cand r where r.plan_id = a.plan_id and a.iy between r.y0 and r.y1 and (r.x0 = b.ix or r.x1 = a.ix))
  union all select a.plan_id, a.iy, a.ix, b.iy, b.ix from cl a join cl b on a.plan_id = b.plan_id and a.cls = b.cls and a.label = b.label and b.ix = a.ix and b.iy = a.iy + 1
  where not exists (select 1 from cand r where r.plan_id = a.plan_id and a.ix between r.x0 and r.x1 and (r.y0 = b.iy or r.y1 = a.iy))),
step as (select * from one union all select plan_id, jy, jx, iy, ix from one),
reach as (select plan_id, iy, ix, iy as ry, ix as rx from cl union select r.plan_id, r.iy, r.ix, s.jy, s.jx from reach r join step s on s.plan_id = r.plan_id and s.iy = r.ry and s.ix = r.rx),
rooted as (select plan_id, iy, ix, min(ry * 1048576 + rx) as root from reach group by plan_id, iy, ix),
unit as (select r.plan_id, r.iy, r.ix, c.label, c.cls, r.root, dense_rank() over (partition by r.plan_id order by r.root) - 1 as unit from rooted r join cl c on c.plan_id = r.plan_id and c.iy = r.iy and c.ix = r.ix),
unit_row as (select u.plan_id, u.iy, u.ix, n.threshold, n.need, row_number() over (partition by u.plan_id order by u.iy, u.ix, n.threshold) - 1 as row_id from unit u join needs n on n.plan_id = u.plan_id and n.cls = u.cls where u.root = u.iy * 1048576 + u.ix),
ucov as (select c.plan_id, c.cand_id, r.row_id from cand c join unit_row r on r.plan_id = c.plan_id and r.ix between c.x0 and c.x1 and r.iy between c.y0 and c.y1 and r.threshold <= c.cls)
"""


@query(_units_sql(fx.BOXES12) + "select plan_id, iy, ix, unit from unit")
def m03_units(spark, sf_dir):
    c = Cover.of(spark, sf_dir, fx.BOXES12)
    return _units(c, c.listed).select("plan_id", "iy", "ix", "unit")


@query(_units_sql(fx.BOXES12) + "select plan_id, unit, cast(floor(root / 1048576) as bigint) as iy, root % 1048576 as ix, label, cls as profile, count(*) as size from unit group by all")
def m03_unit_rows(spark, sf_dir):
    c = Cover.of(spark, sf_dir, fx.BOXES12)
    return mosaic.unit_rows(_units(c, c.listed))


@query(_units_sql(fx.ALL6) + "select plan_id, row_id, string_agg(cand_id, ',' order by cand_id) as cand_ids, count(*) as n from ucov group by plan_id, row_id")
def p04_unit_candidates(spark, sf_dir):
    c = Cover.of(spark, sf_dir, fx.ALL6)
    return model.row_candidates(model.incidence(c.candidates, _rows(c))).select("plan_id", "row_id", F.array_join("cand_ids", ",").alias("cand_ids"), F.size("cand_ids").cast("long").alias("n"))


@query(_units_sql(fx.ALL6) + ", sel as (select plan_id, cand_id, row_number() over (partition by plan_id order by cand_id) - 1 as local_id from cand where x1 > x0) select s.plan_id, local_id, s.cand_id, row_id from sel s join ucov u on u.plan_id = s.plan_id and u.cand_id = s.cand_id")
def p05_unit_subset(spark, sf_dir):
    c = Cover.of(spark, sf_dir, fx.ALL6)
    return model.subset(model.incidence(c.candidates, _rows(c)), c.candidates.where("x1 > x0"))


def _digest_sql(name: str, source: str, group: str, *columns: str) -> str:
    text = " || ',' || ".join(f"cast({c} as varchar)" for c in columns)
    return f"{name} as (select plan_id, sha256(string_agg(h, '' order by h)) as h from (select plan_id, sha256(string_agg(t, ';' order by t)) as h from (select plan_id, {group} as g, {text} as t from {source}) group by plan_id, g) group by plan_id)"


_DIGESTS = {
    "d_cells": ("cell", "iy", "iy", "ix", "cls"),
    "d_x": ("ex", "i", "i", "cast(lo as decimal(28,6))", "cast(hi as decimal(28,6))"),
    "d_y": ("ey", "i", "i", "cast(lo as decimal(28,6))", "cast(hi as decimal(28,6))"),
    "d_cands": ("cand", "x0", "x0", "y0", "x1", "y1", "cls"),
    "d_densities": ("(select * from classes where density is not null)", "cls", "cls", "cast(density as decimal(28,6))"),
    "d_holds": ("holds", "cls", "cls", "cast(hold as decimal(28,6))"),
    "d_recipes": ("layers", "cls", "cls", "array_to_string(list_sort(layers), '+')"),
}


@query(
    f"with {cs.rectangles(fx.BOXES12)}, " + ", ".join(_digest_sql(n, *d) for n, d in _DIGESTS.items()) + " select c.plan_id, sha256(concat_ws('|', " + ", ".join(f"coalesce({n}.h, '-')" for n in _DIGESTS) + ", 'y', '0')) as problem_id from d_cells c join d_cells on d_cells.plan_id = c.plan_id "
    + " ".join(f"left join {n} on {n}.plan_id = c.plan_id" for n in list(_DIGESTS)[1:])
)
def p07_problem_ids(spark, sf_dir):
    c = Cover.of(spark, sf_dir, fx.BOXES12)
    return model.problem_ids(c.cells, c.x, c.y, c.candidates, c.catalogue[0], c.holds, c.layers, "y")
