"""Queries of axis quantisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.kernels.grid import Budget
from gridloom.operators import grids, quantise
from gridloom.plans import cover_sql as cs
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.plans.cover import Cover
from gridloom.session import stored

#: Part of an axis's extent that a line may move by, and stretches asked for.
SHIFT, LINES, WIDTH = 0.2, 6, 700

_EVENTS = f"""with recursive {cs.compact(fx.BOXES12)},
one as (select g.*, x.lo as x0, x.hi as x1, y.lo as y0, y.hi as y1 from grid g join ex x on x.plan_id = g.plan_id and x.i = g.ix join ey y on y.plan_id = g.plan_id and y.i = g.iy),
turn as (select * from (values ('x', -1, 0), ('x', 1, 0), ('y', 0, -1), ('y', 0, 1)) as t(axis, dx, dy)),
ring as (select o.plan_id, t.axis, case when t.dx < 0 then x0 when t.dx > 0 then x1 when t.dy < 0 then y0 else y1 end as coord, case t.axis when 'x' then y1 - y0 else x1 - x0 end as length, o.load, t.dx + t.dy < 0 as beyond
  from one o cross join turn t left join grid n on n.plan_id = o.plan_id and n.ix = o.ix + t.dx and n.iy = o.iy + t.dy where o.load > 0 and coalesce(n.load, 0) <> o.load),
scale as (select plan_id, quantile_cont(load, 0.95) as scale from (select distinct plan_id, load from grid where load > 0) group by plan_id),
priced as (select r.*, power(least(r.load / s.scale, 1.0), 2) as t from ring r join scale s on s.plan_id = r.plan_id),
summed as (select plan_id, axis, coord, sum(length * (0.03 + t) * case when beyond then 1 else 20 end) as w_minus, sum(length * (0.03 + t) * case when beyond then 20 else 1 end) as w_plus,
  min(1 - (1 - case when beyond then 0.5 else 0.1 end) * t) as t_minus, min(1 - (1 - case when beyond then 0.1 else 0.5 end) * t) as t_plus from priced group by plan_id, axis, coord),
ends as (select plan_id, axis, min(coord) as a, max(coord) as z from summed group by plan_id, axis),
events as (select s.plan_id, s.axis, row_number() over (partition by s.plan_id, s.axis order by coord) - 1 as idx, coord, w_minus, w_plus,
  case when coord in (a, z) then 0.0 else (z - a) * {SHIFT}::double * t_minus end as tol_minus, case when coord in (a, z) then 0.0 else (z - a) * {SHIFT}::double * t_plus end as tol_plus from summed s join ends e on e.plan_id = s.plan_id and e.axis = s.axis)"""


def _events(spark, sf_dir, c=None):
    c = c or Cover.of(spark, sf_dir)
    return quantise.axis_events(c.loads, c.x, c.y, "x", SHIFT).unionByName(quantise.axis_events(c.loads, c.y, c.x, "y", SHIFT))


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(f"{_EVENTS} select plan_id, axis, idx, coord, round(w_minus, 3) as w_minus, round(w_plus, 3) as w_plus, round(tol_minus, 5) as tol_minus, round(tol_plus, 5) as tol_plus from events")
def q03_axis_events(spark, sf_dir):
    return _rounded(_events(spark, sf_dir), w_minus=3, w_plus=3, tol_minus=5, tol_plus=5)


@query(f"{_EVENTS} select plan_id, axis, idx, round(case when idx % 2 = 0 then 0 else 3 * tol_minus end, 5) as tol_minus, round(case when idx % 3 = 0 then 0 else 3 * tol_plus end, 5) as tol_plus from events")
def q16_locked_scaled(spark, sf_dir):
    got = quantise.locked(quantise.scaled_tolerances(_events(spark, sf_dir), 3), F.col("idx") % 2 == 0, F.col("idx") % 3 == 0)
    return _rounded(got, tol_minus=5, tol_plus=5).select("plan_id", "axis", "idx", "tol_minus", "tol_plus")


@query(
    f"{_EVENTS}, span as (select plan_id, axis, idx, coord - tol_minus as lo, coord + tol_plus as hi from events), "
    "fold as (select plan_id, axis, idx, lo, hi, 1 as n from span where idx = 0 union all select s.plan_id, s.axis, s.idx, case when greatest(f.lo, s.lo) > least(f.hi, s.hi) + 1e-12 then s.lo else greatest(f.lo, s.lo) end, "
    "case when greatest(f.lo, s.lo) > least(f.hi, s.hi) + 1e-12 then s.hi else least(f.hi, s.hi) end, n + case when greatest(f.lo, s.lo) > least(f.hi, s.hi) + 1e-12 then 1 else 0 end from fold f join span s on s.plan_id = f.plan_id and s.axis = f.axis and s.idx = f.idx + 1) "
    "select plan_id, axis, max(n) as lines from fold group by plan_id, axis"
)
def q06_min_lines(spark, sf_dir):
    return quantise.minimum_lines(_events(spark, sf_dir))


_COSTS = """, seg as (select a.plan_id, a.axis, a.idx as i, b.idx as j, greatest(a.coord, max(e.coord - e.tol_minus)) as lo, least(b.coord, min(e.coord + e.tol_plus)) as hi
  from events a join events b on a.plan_id = b.plan_id and a.axis = b.axis and a.idx <= b.idx join events e on e.plan_id = a.plan_id and e.axis = a.axis and e.idx between a.idx and b.idx group by a.plan_id, a.axis, a.idx, b.idx, a.coord, b.coord),
tried as (select * from (select *, unnest([lo, hi]) as q from seg where lo <= hi) union select s.*, e.coord from seg s join events e on e.plan_id = s.plan_id and e.axis = s.axis and e.coord between s.lo and s.hi),
sums as (select t.plan_id, t.axis, t.i, t.j, t.q, sum(case when t.q < e.coord then e.w_minus * (e.coord - t.q) else e.w_plus * (t.q - e.coord) end) as cost from tried t join events e on e.plan_id = t.plan_id and e.axis = t.axis and e.idx between t.i and t.j group by all),
cost as (select s.plan_id, s.axis, s.i, s.j, min(c.cost) as cost from seg s left join sums c on c.plan_id = s.plan_id and c.axis = s.axis and c.i = s.i and c.j = s.j group by all)"""


@query(f"{_EVENTS}{_COSTS} select plan_id, axis, i, j, round(cost, 2) as cost from cost")
def q07_segment_costs(spark, sf_dir):
    return _rounded(quantise.segment_costs(_events(spark, sf_dir)).drop("place"), cost=2)


_WALK = """, last as (select plan_id, axis, max(idx) as n from events group by plan_id, axis), walk as (select plan_id, axis, 1 as k, j, cost from cost where i = 0 and cost is not null
union all select plan_id, axis, k, j, min(cost) from (select w.plan_id, w.axis, w.k + 1 as k, c.j, w.cost + c.cost as cost from walk w join cost c on c.plan_id = w.plan_id and c.axis = w.axis and c.i = w.j + 1 where c.cost is not null) group by plan_id, axis, k, j),
best as (select w.plan_id, w.axis, k, min(cost) as cost from walk w join last l on l.plan_id = w.plan_id and l.axis = w.axis and l.n = w.j group by w.plan_id, w.axis, k)"""


@query(f"{_EVENTS}{_COSTS}{_WALK} select plan_id, axis, k, round(cost, 2) as cost from best")
def q09_exact_frontier(spark, sf_dir):
    return _rounded(quantise.exact_partitions(_events(spark, sf_dir)), cost=2)


#: The sides of boxes without a load, as holes that must not close.
_HOLES = f"select plan_id, 'x' as axis, x0 as low, x1 as high from ({fx.BOXES12}) as h where load = 0 union all select plan_id, 'y', y0, y1 from ({fx.BOXES12}) as v where load = 0"
_LIMITS = f""", hole as ({_HOLES}), pair as (select a.plan_id, a.axis, a.idx as a, b.idx as b from hole h join events a on a.plan_id = h.plan_id and a.axis = h.axis and a.coord = h.low join events b on b.plan_id = h.plan_id and b.axis = h.axis and b.coord = h.high),
lim as (select e.plan_id, e.axis, e.idx, min(p.b) - 1 as last from events e left join pair p on p.plan_id = e.plan_id and p.axis = e.axis and p.a >= e.idx group by all)"""
_HELD = """, held as (select c.* from cost c join lim l on l.plan_id = c.plan_id and l.axis = c.axis and l.idx = c.i where l.last is null or c.j <= l.last)"""


def _limited(spark, sf_dir):
    return quantise.stretch_limits(_events(spark, sf_dir), fx.view(spark, sf_dir, _HOLES))


@query(f'{_EVENTS}{_LIMITS} select plan_id, axis, idx, last as "limit" from lim')
def q05_limits(spark, sf_dir):
    return _limited(spark, sf_dir).select("plan_id", "axis", "idx", "limit")


_HELD_WALK = _WALK.replace("join cost c", "join held c").replace("from cost where", "from held where")


@query(f"{_EVENTS}{_COSTS}{_LIMITS}{_HELD}{_HELD_WALK} select plan_id, axis, k, round(cost, 2) as cost from best")
def q05_frontier(spark, sf_dir):
    return _rounded(quantise.exact_partitions(_limited(spark, sf_dir)), cost=2)


@query(f"{_EVENTS}{_COSTS}{_LIMITS}{_HELD}{_HELD_WALK} select plan_id, axis, cast(min(k) as int) as lines from best group by plan_id, axis")
def q05_min_lines(spark, sf_dir):
    return quantise.minimum_lines(_limited(spark, sf_dir))


def _moved(spark, sf_dir, greedy):
    """Per plan and axis: stretches, what their moves cost, and whether it can be done."""
    events = _events(spark, sf_dir)
    move = F.when(F.col("line") < F.col("coord"), F.col("w_minus") * (F.col("coord") - F.col("line"))).otherwise(F.col("w_plus") * (F.col("line") - F.col("coord")))
    got = quantise.quantised(events, LINES, greedy).join(events.select("plan_id", "axis", "idx", "w_minus", "w_plus"), ["plan_id", "axis", "idx"])
    return got.groupBy("plan_id", "axis").agg((F.max("stretch") + 1).alias("lines"), F.round(F.sum(move), 2).alias("cost"), F.max("problem").alias("problem"))


@query(
    f"{_EVENTS}{_COSTS}{_WALK} select l.plan_id, l.axis, case when b.k is not null then l.want end as lines, round(b.cost, 2) as cost, case when b.k is null then 'lines' end as problem "
    f"from (select *, least({LINES}, n + 1) as want from last) l left join best b on b.plan_id = l.plan_id and b.axis = l.axis and b.k = l.want"
)
def q11_quantise_exact(spark, sf_dir):
    return _moved(spark, sf_dir, False)


@query()
def q12_quantise_greedy(spark, sf_dir):
    return _moved(spark, sf_dir, True)


@query()
def q13_greedy_frontier(spark, sf_dir):
    return _rounded(quantise.greedy_partitions(_events(spark, sf_dir)), cost=2)


def _snapped(spark, sf_dir):
    c = Cover.of(spark, sf_dir).kept()
    moves = stored(quantise.quantised(_events(spark, sf_dir, c), LINES).where("problem is null"), "moves")  # read for each axis
    return c, quantise.snapped(c.loads, c.x, c.y, moves)


@query()
def q15_snapped(spark, sf_dir):
    return _rounded(_snapped(spark, sf_dir)[1], x0=3, y0=3, x1=3, y1=3)


@query()
def q21_order_violations(spark, sf_dir):
    c, cells = _snapped(spark, sf_dir)
    return _rounded(quantise.ground_gained(cells, c.loads, c.x, c.y, 1e-6), outside=2)


@query(
    f"with b as ({fx.BOXES60}), v as (select distinct plan_id, x0 as v from b), l as (select distinct plan_id, cast(floor(x1 / 700) * 700 as bigint) as coord from b) "
    "select v.plan_id, v.v, case when min(abs(l.coord - v.v)) <= 300 then arg_min(l.coord, abs(l.coord - v.v) * 1000000 + l.coord) end as coord from v join l on l.plan_id = v.plan_id group by v.plan_id, v.v"
)
def q14_nearest(spark, sf_dir):
    b = fx.view(spark, sf_dir, fx.BOXES60)
    lines = b.select("plan_id", (F.floor(F.col("x1") / 700) * 700).cast("long").alias("coord")).distinct()
    return quantise.nearest_lines(b.select("plan_id", F.col("x0").alias("v")), lines, 300)


@query(
    f"{_EVENTS}, bnd as (select *, coord - tol_minus as lo, coord + tol_plus as hi from events), up as (select *, lo as early from bnd where idx = 0 union all select n.*, greatest(n.lo, u.early + {WIDTH}) from up u join bnd n on n.plan_id = u.plan_id and n.axis = u.axis and n.idx = u.idx + 1), "
    f"down as (select *, hi as late from bnd where (plan_id, axis, idx) in (select (plan_id, axis, max(idx)) from bnd group by plan_id, axis) union all select n.*, least(n.hi, d.late - {WIDTH}) from down d join bnd n on n.plan_id = d.plan_id and n.axis = d.axis and n.idx = d.idx - 1), "
    "met as (select u.*, d.late, min(case when u.early <= d.late + 1e-9 then 1 else 0 end) over (partition by u.plan_id, u.axis) as ok from up u join down d on d.plan_id = u.plan_id and d.axis = u.axis and d.idx = u.idx), "
    f"chain as (select plan_id, axis, idx, coord, ok, least(greatest(cast(coord as double), early), late) as moved from met where idx = 0 union all select n.plan_id, n.axis, n.idx, n.coord, n.ok, least(greatest(cast(n.coord as double), n.early, c.moved + {WIDTH}), n.late) from chain c join met n on n.plan_id = c.plan_id and n.axis = c.axis and n.idx = c.idx + 1) "
    "select plan_id, axis, idx, coord as line, case when ok = 1 then round(moved, 3) end as moved from chain"
)
def q18_spacing(spark, sf_dir):
    e = _events(spark, sf_dir).select("plan_id", "axis", "idx", F.col("coord").alias("line"), (F.col("coord") - F.col("tol_minus")).alias("lower"), (F.col("coord") + F.col("tol_plus")).alias("upper"))
    return _rounded(quantise.spaced(e, WIDTH), moved=3)


@query(
    f"with recursive {cs.compact(fx.BOXES12)}, own as (select g.plan_id, g.load, sum((x.hi - x.lo) * (y.hi - y.lo)) as own from grid g join ex x on x.plan_id = g.plan_id and x.i = g.ix join ey y on y.plan_id = g.plan_id and y.i = g.iy group by g.plan_id, g.load) "
    "select a.plan_id, a.load, cast(sum(b.own) as bigint) as area from own a join own b on b.plan_id = a.plan_id and b.load >= a.load group by a.plan_id, a.load"
)
def q20_allowed(spark, sf_dir):
    c = Cover.of(spark, sf_dir)
    return grids.allowed(c.loads, c.x, c.y)


BUDGET = Budget(most=(10, None), most_cells=90, width=(250, None), scale=4.0)


def _grid_lines(spark, sf_dir):
    c = Cover.of(spark, sf_dir).kept()
    return grids.quantised_plans(_events(spark, sf_dir, c), c.loads, c.x, c.y, BUDGET, dealt=True)


@query()
def q22_locked_lines(spark, sf_dir):
    return _rounded(_grid_lines(spark, sf_dir), line=3, cost=2, scale=6, worst=2).select("plan_id", "axis", "idx", "coord", "line", "locked_minus", "locked_plus", "problem")


@query()
def q23_quantised(spark, sf_dir):
    return _rounded(grids.plans(_grid_lines(spark, sf_dir)), cost_x=2, cost_y=2, scale=6, worst=2)
