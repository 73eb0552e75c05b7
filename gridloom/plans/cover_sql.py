"""The same chain as SQL for the oracle: common table expressions that build on each other."""

from __future__ import annotations

from gridloom.plans import fixtures as fx


def raster(boxes: str) -> str:
    return f"""
b as ({boxes}),
xl as (select plan_id, row_number() over (partition by plan_id order by v) - 1 as i, v as lo, lead(v) over (partition by plan_id order by v) as hi from (select plan_id, x0 as v from b union select plan_id, x1 from b)),
yl as (select plan_id, row_number() over (partition by plan_id order by v) - 1 as i, v as lo, lead(v) over (partition by plan_id order by v) as hi from (select plan_id, y0 as v from b union select plan_id, y1 from b)),
raw as (
  select x.plan_id, y.i as iy, x.i as ix, max(b.load) as load from xl x join yl y on x.plan_id = y.plan_id
  left join b on b.plan_id = x.plan_id and b.x0 <= x.lo and b.x1 >= x.hi and b.y0 <= y.lo and b.y1 >= y.hi where x.hi is not null and y.hi is not null group by all)"""


def compact(boxes: str) -> str:
    return (
        raster(boxes)
        + """,
kx as (select plan_id, line, row_number() over (partition by plan_id order by line) - 1 as k, max(line) over (partition by plan_id) as top from (
  select plan_id, ix as line from (select *, lag(load) over (partition by plan_id, iy order by ix) as p from raw) where load is distinct from p
  union select plan_id, ix + 1 from (select *, lead(ix) over (partition by plan_id, iy order by ix) as n from raw) where n is null and load is not null)),
ky as (select plan_id, line, row_number() over (partition by plan_id order by line) - 1 as k, max(line) over (partition by plan_id) as top from (
  select plan_id, iy as line from (select *, lag(load) over (partition by plan_id, ix order by iy) as p from raw) where load is distinct from p
  union select plan_id, iy + 1 from (select *, lead(iy) over (partition by plan_id, ix order by iy) as n from raw) where n is null and load is not null)),
grid as (select r.plan_id, ky.k as iy, kx.k as ix, coalesce(r.load, 0) as load from raw r join kx on r.plan_id = kx.plan_id and r.ix = kx.line and kx.line < kx.top join ky on r.plan_id = ky.plan_id and r.iy = ky.line and ky.line < ky.top),
ex as (select * from (select k.plan_id, k.k as i, l.lo, lead(l.lo) over (partition by k.plan_id order by k.k) as hi from kx k join xl l on k.plan_id = l.plan_id and k.line = l.i) where hi is not null),
ey as (select * from (select k.plan_id, k.k as i, l.lo, lead(l.lo) over (partition by k.plan_id order by k.k) as hi from ky k join yl l on k.plan_id = l.plan_id and k.line = l.i) where hi is not null)"""
    )


CLASSES = f"""
stock as ({fx.STOCK}),
arms as (select stock_id as s, diameter, step, cast(round(10 * power(diameter / 2.0, 2) * pi() / step, 1) as decimal(10,1)) as arm from stock),
variants as (
  select cast([] as integer[]) as combo, 0 as len, cast(round(10 * power(18 / 2.0, 2) * pi() / 300, 1) as decimal(10,1)) as value
  union all select [s], 1, cast(round(10 * power(18 / 2.0, 2) * pi() / 300, 1) as decimal(10,1)) + arm from arms
  union all select [a.s, b.s], 2, cast(round(10 * power(18 / 2.0, 2) * pi() / 300, 1) as decimal(10,1)) + a.arm + b.arm from arms a join arms b on a.s <= b.s),
picked as (select l.plan_id, l.load, arg_min(v.combo, {{'v': v.value, 'l': v.len, 'c': v.combo}}) as combo from (select distinct plan_id, load from b) l join variants v on v.value > l.load group by all),
classes as (
  select k.plan_id, row_number() over (partition by k.plan_id order by v.value, v.len, v.combo) - 1 as cls, v.combo, v.len, v.value, a.arm as density, a.diameter, a.step
  from (select plan_id, combo from picked union select plan_id, cast([] as integer[]) from picked union select plan_id, [unnest(combo)] from picked) k join variants v on v.combo = k.combo left join arms a on v.combo = [a.s]),
layers as (
  select c.plan_id, c.cls, list_sort(list(base.cls)) as layers from (select plan_id, cls, unnest(combo) as s from classes) c
  join classes base on base.plan_id = c.plan_id and base.combo = [c.s] group by c.plan_id, c.cls),
holds as (
  select c.plan_id, c.cls, max({fx.ANCHOR_FACTOR} * a.diameter) as hold from (select plan_id, cls, unnest(combo) as s from classes) c join arms a on a.s = c.s group by c.plan_id, c.cls)"""


def classed(boxes: str) -> str:
    return (
        compact(boxes)
        + ","
        + CLASSES
        + """,
cell as (select g.plan_id, g.iy, g.ix, case when g.load = 0 then 0 else c.cls end as cls from grid g left join picked p on p.plan_id = g.plan_id and p.load = g.load left join classes c on c.plan_id = p.plan_id and c.combo = p.combo)"""
    )


def rectangles(boxes: str) -> str:
    return (
        classed(boxes)
        + f""",
act as (select distinct c.plan_id, c.ix, e.lo, e.hi from cell c join ex e on e.plan_id = c.plan_id and e.i = c.ix where c.cls > 0),
span as (select l.plan_id, l.ix as x0, r.ix as x1 from act l join act r on l.plan_id = r.plan_id and r.ix >= l.ix and r.hi - l.lo >= {fx.MIN_WIDTH}),
prof as (select s.plan_id, s.x0, s.x1, c.iy, max(c.cls) as cls from span s join cell c on c.plan_id = s.plan_id and c.ix between s.x0 and s.x1 and c.cls > 0 group by all),
mark as (
  select p.*, e.lo, e.hi, h.hold, lag(p.cls) over w as pc, lag(e.hi) over w as ph from prof p join ey e on e.plan_id = p.plan_id and e.i = p.iy join holds h on h.plan_id = p.plan_id and h.cls = p.cls
  window w as (partition by p.plan_id, p.x0, p.x1 order by p.iy)),
numbered as (select *, sum(case when pc = cls and lo - ph <= hold then 0 else 1 end) over (partition by plan_id, x0, x1 order by iy rows unbounded preceding) as run from mark),
runs as (select plan_id, x0, x1, run, min(iy) as y0, max(iy) as y1, min(cls) as cls from numbered group by plan_id, x0, x1, run),
spanned as (select a.plan_id, a.x0, a.x1, a.y0, z.y1, max(m.cls) as cls from runs a join runs z on z.plan_id = a.plan_id and z.x0 = a.x0 and z.x1 = a.x1 and z.run >= a.run
  join runs m on m.plan_id = a.plan_id and m.x0 = a.x0 and m.x1 = a.x1 and m.run between a.run and z.run group by a.plan_id, a.x0, a.x1, a.run, a.y0, z.run, z.y1),
rect as (select distinct plan_id, x0, y0, x1, y1, cls from spanned s where exists (select 1 from cell c where c.plan_id = s.plan_id and c.cls > 0 and (c.ix = s.x0 or c.ix = s.x1) and c.iy between s.y0 and s.y1)),
cand as (select *, row_number() over (partition by plan_id order by x0, y0, x1, y1, cls) - 1 as cand_id from (
  select distinct r.plan_id, x0, y0, x1, y1, unnest(l.layers) as cls from rect r join layers l on l.plan_id = r.plan_id and l.cls = r.cls))"""
    )


def model(boxes: str) -> str:
    return (
        rectangles(boxes)
        + """,
priced as (
  select c.*, (b2.hi - a.lo) * (t.hi - s.lo) as base_area, (b2.hi - a.lo) * (least(y.high, t.hi + h.hold) - greatest(y.low, s.lo - h.hold)) as area, h.hold, cast(k.density as double) as density,
    round((b2.hi - a.lo) * (least(y.high, t.hi + h.hold) - greatest(y.low, s.lo - h.hold)) * cast(k.density as double), 1) as cost
  from cand c join ex a on a.plan_id = c.plan_id and a.i = c.x0 join ex b2 on b2.plan_id = c.plan_id and b2.i = c.x1 join ey s on s.plan_id = c.plan_id and s.i = c.y0 join ey t on t.plan_id = c.plan_id and t.i = c.y1
  join (select plan_id, min(lo) as low, max(hi) as high from ey group by plan_id) y on y.plan_id = c.plan_id join holds h on h.plan_id = c.plan_id and h.cls = c.cls join classes k on k.plan_id = c.plan_id and k.cls = c.cls),
needs as (select plan_id, cls, threshold, length(list_filter(layers, lambda v: v >= threshold)) as need from (select plan_id, cls, layers, unnest(list_distinct(layers)) as threshold from layers)),
need_row as (select c.plan_id, c.iy, c.ix, n.threshold, n.need, row_number() over (partition by c.plan_id order by c.iy, c.ix, n.threshold) - 1 as row_id from cell c join needs n on n.plan_id = c.plan_id and n.cls = c.cls where c.cls > 0),
cov as (select c.plan_id, c.cand_id, r.row_id, r.need from cand c join need_row r on r.plan_id = c.plan_id and r.ix between c.x0 and c.x1 and r.iy between c.y0 and c.y1 and r.threshold <= c.cls),
bound as (select c.plan_id, c.cand_id, greatest(1, coalesce(max(v.need), 0)) as ub from cand c left join cov v on v.plan_id = c.plan_id and v.cand_id = c.cand_id group by c.plan_id, c.cand_id),
total as (select plan_id, count(*) as n_rows, max(need) as worst, count(*) filter (need = 2) as n_twice from need_row group by plan_id),
single as (
  select t.plan_id, t.n_rows, f.cand_id is not null as feasible, f.cand_id, f.cost from total t left join (
    select p.plan_id, arg_min(p.cand_id, {'c': p.cost, 'i': p.cand_id}) as cand_id, min(p.cost) as cost from priced p join total t on t.plan_id = p.plan_id
    where (select count(*) from cov v where v.plan_id = p.plan_id and v.cand_id = p.cand_id and v.need = 1) = t.n_rows group by p.plan_id) f on f.plan_id = t.plan_id)"""
    )
