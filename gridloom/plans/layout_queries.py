"""Queries of bars and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import layout
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query

#: Zones made of boxes: class by load, the stock's steps and diameters.
ZONES = f"select plan_id, poly_id as zone_id, cast(1 + load / 10 as int) as cls, x0, y0, x1, y1, cast(case when load >= 30 then 100 when load >= 10 then 150 else 250 end as bigint) as step, cast(32 * (18 + load / 10) as bigint) as hold, 18 + load / 10 as diameter from ({fx.BOXES12}) as b"


def _zones(spark, sf_dir):
    return fx.view(spark, sf_dir, ZONES).withColumn("diameter", F.col("diameter").cast("double"))


_Z = f"with z as ({ZONES})"
_B = f"{_Z}, bars as (select plan_id, zone_id, cls, bar, x0 + bar * step as x, y0, y1 from (select *, unnest(generate_series(0, cast(round_even((x1 - x0) / step, 0) as bigint))) as bar from z))"


@query(f"{_Z} select plan_id, zone_id, cast(floor(x0 / 300) as bigint) as x0, cast(floor(y0 / 300) as bigint) as y0, cast(ceil(x1 / 300) as bigint) as x1, cast(ceil(y1 / 300) as bigint) as y1 from z")
def l04_scaled(spark, sf_dir):
    return layout.scaled(_zones(spark, sf_dir), 300)


@query(f"{_Z} select plan_id, zone_id, cast(ceil(greatest(1, 1000, x1 - x0) / step) * step as bigint) as width from z")
def l06_zone_fit(spark, sf_dir):
    return _zones(spark, sf_dir).select("plan_id", "zone_id", layout.fitted_width(F.col("x1") - F.col("x0"), F.lit(1000), F.col("step")).cast("long").alias("width"))


_FIT = "select plan_id, zone_id, x0, x1, x0 + zone_id % 4 * 200 as n0, x0 + zone_id % 4 * 200 + zone_id % 5 * 400 as n1, case zone_id % 3 when 0 then 1000 when 1 then 1700 else 6500 end as length"


@query(
    f"{_Z}, f as ({_FIT} from z), p as (select *, (select min(q) from (select unnest([0.0, 6000 - length, n0, n1 - length, (x0 + x1 - length) / 2.0]) as q) where q >= 0 and q + length <= 6000 and q <= n0 and q + length >= n1) as any_place from f) "
    "select plan_id, zone_id, case when any_place is not null then cast((select arg_min(q, abs(q - (x0 + x1 - length) / 2.0)) from (select unnest([0.0, 6000 - length, n0, n1 - length, (x0 + x1 - length) / 2.0]) as q) where q >= 0 and q + length <= 6000 and q <= n0 and q + length >= n1) as double) end as start from p"
)
def l05_interval(spark, sf_dir):
    z = _zones(spark, sf_dir).selectExpr(*_FIT.replace("select ", "", 1).split(", "))
    start = layout.fitted_interval(*(F.col(c) for c in ("x0", "x1", "n0", "n1", "length")), F.lit(0), F.lit(6000))
    return z.select("plan_id", "zone_id", start.cast("double").alias("start"))


@query(f"{_Z} select a.plan_id, a.zone_id as a, b.zone_id as b, a.x1 as at from z a join z b on a.plan_id = b.plan_id and a.cls = b.cls and a.zone_id <> b.zone_id and a.x1 = b.x0 and a.y0 <= b.y1 and b.y0 <= a.y1".replace(" as at", ' as "at"'))
def l08_contacts(spark, sf_dir):
    return layout.contacts(_zones(spark, sf_dir))


@query(
    f"{_Z}, m as (select *, step * case when cls = max(cls) over (partition by plan_id) then 2 else 1 end as reach from z) "
    "select a.plan_id, a.zone_id, max(case when b.x1 = a.x0 then a.x0 - a.reach end) as low, min(case when b.x0 = a.x1 then a.x1 + a.reach end) as high "
    "from m a left join m b on a.plan_id = b.plan_id and a.cls = b.cls and a.zone_id <> b.zone_id and a.y0 <= b.y1 and b.y0 <= a.y1 group by a.plan_id, a.zone_id"
)
def l08_limits(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return layout.touch_limits(z, z.groupBy("plan_id").agg(F.max("cls").alias("cls")))


#: What boxes ask for: no layer for no load, else one or two.
_NEEDS = f"select plan_id, poly_id, case when load = 0 then array() when poly_id % 3 = 0 then array(cast(1 + load / 10 as int), 2) else array(cast(1 + load / 10 as int)) end as layers from ({fx.BOXES12})"
_WANT = f"{_Z}, b as ({fx.BOXES12}), n as (select plan_id, poly_id, unnest(case when load = 0 then [] when poly_id % 3 = 0 then [cast(1 + load / 10 as int), 2] else [cast(1 + load / 10 as int)] end) as c from b), want as (select t.plan_id, t.poly_id, t.c as threshold, count(*) as need from (select distinct * from n) t join n on n.plan_id = t.plan_id and n.poly_id = t.poly_id and n.c >= t.c group by all)"


@query(f"{_WANT} select plan_id, poly_id, threshold, need from want")
def l02_profiles(spark, sf_dir):
    return layout.profiles(fx.view(spark, sf_dir, _NEEDS))


@query(f"{_WANT} select plan_id, row_number() over (partition by plan_id order by load desc, threshold desc) - 1 as stage, load, threshold from (select distinct w.plan_id, load, threshold from want w join b on b.plan_id = w.plan_id and b.poly_id = w.poly_id)")
def l07_stages(spark, sf_dir):
    return layout.stages(fx.view(spark, sf_dir, fx.BOXES12), fx.view(spark, sf_dir, _NEEDS))


@query(f"{_WANT} select w.plan_id, w.threshold, arg_min(z.cls, z.step * 100 + z.cls) as cls from (select distinct plan_id, threshold from want) w left join z on z.plan_id = w.plan_id and z.cls >= w.threshold and z.zone_id % 2 = 0 group by w.plan_id, w.threshold")
def l10_new_classes(spark, sf_dir):
    z = _zones(spark, sf_dir).where("zone_id % 2 = 0")
    return layout.new_classes(layout.profiles(fx.view(spark, sf_dir, _NEEDS)), z.selectExpr("plan_id", "cls", "step as density").distinct())


@query("with s as (select p_partkey as id, p_size * 10 as a, (1 + p_partkey % 40) * 10 as b from part) select id, gcd(a, b) as g, coalesce((select min(d) from generate_series(20, 500) t(d) where d <= gcd(a, b) and gcd(a, b) % d = 0), gcd(a, b)) as quantum from s")
def l13_quantum(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "p_size * 10 as a", "(1 + p_partkey % 40) * 10 as b")
    return s.select("id", layout.gcd(F.col("a"), F.col("b")).alias("g"), layout.quantum(F.col("a"), F.col("b"), 20).alias("quantum"))


@query(f"{_B} select plan_id, zone_id, cls, bar, x, y0, y1 from bars")
def l15_positions(spark, sf_dir):
    return layout.positions(_zones(spark, sf_dir))


@query(
    "with s as (select p_partkey as id, (1 + p_size % 6) * 50 as a, (1 + p_partkey % 6) * 50 as b from part) select id, case when a = b then case when a = 300 then a / 2 else 0 end when greatest(a, b) % least(a, b) = 0 then "
    "case when greatest(a, b) = 2 * least(a, b) then case when least(a, b) / 3 >= 50 then greatest(a, b) / 3 else least(a, b) / 2 end else 0 end when gcd(a, b) >= 100 then gcd(a, b) / 2 else 0 end as phase, "
    "least((id % a + a) % a, a - (id % a)) as distance from s"
)
def l18_phase(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as id", "(1 + p_size % 6) * 50 as a", "(1 + p_partkey % 6) * 50 as b")
    return s.select("id", layout.preferred_phase(F.col("a"), F.col("b"), F.lit(300), 50).alias("phase"), layout.cyclic_distance(F.col("id"), F.lit(0), F.col("a")).alias("distance"))


@query(
    f"{_B}, w as (select b.*, z.x0, z.x1 from bars b join z on z.plan_id = b.plan_id and z.zone_id = b.zone_id), p as (select a.plan_id, a.zone_id as a, b.zone_id as b, abs(b.x - a.x) as distance, a.x as xa, b.x as xb, greatest(a.y0, b.y0) as y0, least(a.y1, b.y1) as y1 "
    "from w a join w b on a.plan_id = b.plan_id and a.zone_id < b.zone_id and a.x <> b.x and least(a.y1, b.y1) > greatest(a.y0, b.y0) and least(a.x, b.x) >= greatest(a.x0, b.x0) and greatest(a.x, b.x) <= least(a.x1, b.x1)) "
    "select * from p where distance < 60 qualify row_number() over (partition by plan_id, a, b order by distance, xa, xb) = 1"
)
def l20_close_pairs(spark, sf_dir):
    return layout.close_pairs(fx.dealt(spark, sf_dir, ZONES), 60)


#: The same zones closer together, so that three of them share bars.
_DENSE = ZONES.replace(fx.BOXES12, fx.DENSE12)


@query(
    f"{_B.replace(ZONES, _DENSE)}, w as (select b.*, z.x0, z.x1 from bars b join z on z.plan_id = b.plan_id and z.zone_id = b.zone_id) select a.plan_id, a.zone_id as a, b.zone_id as b, c.zone_id as c, a.x, greatest(a.y0, b.y0, c.y0) as y0, least(a.y1, b.y1, c.y1) as y1 from w a join w b on a.plan_id = b.plan_id and a.x = b.x and a.zone_id < b.zone_id "
    "join w c on c.plan_id = b.plan_id and c.x = b.x and b.zone_id < c.zone_id where least(a.y1, b.y1, c.y1) > greatest(a.y0, b.y0, c.y0) and a.x between greatest(a.x0, b.x0, c.x0) and least(a.x1, b.x1, c.x1)"
)
def l20_triples(spark, sf_dir):
    return layout.coincident_triples(fx.dealt(spark, sf_dir, _DENSE))


@query(
    f"{_WANT}, o as (select w.plan_id, w.poly_id, w.threshold, w.need, z.zone_id, greatest(0, greatest(z.x0 - b.x0, b.x1 - z.x1) - z.step) as extra from want w join b on b.plan_id = w.plan_id and b.poly_id = w.poly_id join z on z.plan_id = w.plan_id and z.cls >= w.threshold and z.zone_id % 2 = 0 and z.y0 <= b.y0 and z.y1 >= b.y1), "
    "r as (select *, row_number() over (partition by plan_id, poly_id, threshold order by extra, zone_id) as place from o where extra <= 300), c as (select plan_id, poly_id, threshold, count(*) as options, count(*) filter (place <= need and extra > 0) as relaxed from r group by all) "
    "select w.*, coalesce(c.options, 0) as options, case when coalesce(c.options, 0) >= w.need then c.relaxed else 0 end as relaxations, coalesce(c.options, 0) >= w.need as ok from want w left join c on c.plan_id = w.plan_id and c.poly_id = w.poly_id and c.threshold = w.threshold"
)
def l30_coverage(spark, sf_dir):
    return layout.coverage(fx.view(spark, sf_dir, fx.BOXES12), fx.view(spark, sf_dir, _NEEDS), _zones(spark, sf_dir).where("zone_id % 2 = 0"), 300)


@query(
    f"{_B}, m as (select *, max(y1) over (partition by plan_id, cls, x order by y0, y1, zone_id, bar rows between unbounded preceding and 1 preceding) as reach from bars), "
    "p as (select *, sum(case when reach is null or y0 > reach then 1 else 0 end) over (partition by plan_id, cls, x order by y0, y1, zone_id, bar rows unbounded preceding) as piece from m) "
    "select plan_id, cls, x, min(y0) as y0, max(y1) as y1, count(distinct zone_id) as zones from p group by plan_id, cls, x, piece"
)
def l31_bar_merge(spark, sf_dir):
    return layout.shared_bars(layout.positions(_zones(spark, sf_dir)))


@query(
    f"{_B}, e as (select plan_id, x, y0 as y, 1 as d from bars union all select plan_id, x, y1, -1 from bars), o as (select plan_id, x, sum(d) over (partition by plan_id, x order by y, d desc rows unbounded preceding) as open from e) select plan_id, x, cast(max(open) as bigint) as depth from o group by plan_id, x"
)
def l32_depth(spark, sf_dir):
    return layout.depth(layout.positions(_zones(spark, sf_dir)))


@query(
    f"{_B}, f as (select plan_id, min(y0) as low, max(y1) as high from z group by plan_id), a as (select b.*, greatest(f.low, b.y0 - z.hold) as a0, least(f.high, b.y1 + z.hold) as a1 from bars b join z on z.plan_id = b.plan_id and z.zone_id = b.zone_id join f on f.plan_id = b.plan_id) "
    "select plan_id, zone_id, bar, a0 as low, y0 as high from a where y0 > a0 union all select plan_id, zone_id, bar, y1, a1 from a where a1 > y1"
)
def s08_anchorage(spark, sf_dir):
    z = _zones(spark, sf_dir)
    field = z.groupBy("plan_id").agg(F.min("y0").alias("low"), F.max("y1").alias("high"))
    bars = layout.positions(z).join(z.select("plan_id", "zone_id", "hold"), ["plan_id", "zone_id"]).join(field, "plan_id")
    return layout.anchorage_pieces(bars.withColumns({"a0": F.greatest("low", F.col("y0") - F.col("hold")), "a1": F.least("high", F.col("y1") + F.col("hold"))}))


@query(
    f"{_B}, f as (select plan_id, min(y0) as low, max(y1) as high from z group by plan_id), a as (select b.plan_id, b.y1 - b.y0 as plain, least(f.high, b.y1 + z.hold) - greatest(f.low, b.y0 - z.hold) as anchored, 7850 * pi() * power(z.diameter / 1000.0, 2) / 4 / 1000 as m "
    "from bars b join z on z.plan_id = b.plan_id and z.zone_id = b.zone_id join f on f.plan_id = b.plan_id) select plan_id, count(*) as bars, cast(sum(plain) as bigint) as length, cast(sum(anchored) as bigint) as anchored_length, round(sum(plain * m), 3) as mass, round(sum(anchored * m), 3) as anchored_mass from a group by plan_id"
)
def b01_mass(spark, sf_dir):
    z = _zones(spark, sf_dir)
    return layout.steel(z, z.groupBy("plan_id").agg(F.min("y0").alias("low"), F.max("y1").alias("high")), fx.STEEL)


_MISSES = f"""{_WANT}, f as (select plan_id, min(x0) as f0, max(x1) as f1 from b group by plan_id), e as (select b.* from b join f on f.plan_id = b.plan_id where not (b.x0 > f0 and b.x1 < f1)),
m as (select w.plan_id, w.poly_id, w.threshold, w.need, z.zone_id, cast(greatest(0, e.x1 - z.x1, z.x0 - e.x0) as double) as miss from want w join e on e.plan_id = w.plan_id and e.poly_id = w.poly_id join z on z.plan_id = w.plan_id and z.cls >= w.threshold and z.zone_id % 2 = 0 and z.y0 <= e.y0 and z.y1 >= e.y1),
g as (select plan_id, poly_id, threshold, list_sort(list(miss)) as l from m group by all),
r as (select w.*, coalesce(length(list_filter(l, lambda v: v = 0)), 0) as covered, l[w.need] as best_miss, coalesce(length(l), 0) as n, list_sum(l[1:w.need]) as least_sum from want w join e on e.plan_id = w.plan_id and e.poly_id = w.poly_id left join g on g.plan_id = w.plan_id and g.poly_id = w.poly_id and g.threshold = w.threshold)
"""


def _misses(spark, sf_dir):
    boxes = fx.view(spark, sf_dir, fx.BOXES12)
    fields = boxes.groupBy("plan_id").agg(F.min("x0").alias("low"), F.max("x1").alias("high"))
    return layout.edge_misses(boxes, fx.view(spark, sf_dir, _NEEDS), _zones(spark, sf_dir).where("zone_id % 2 = 0"), fields)


@query(_MISSES + "select plan_id, poly_id, threshold, need, covered, best_miss from r where covered < need")
def l28_edge_relaxations(spark, sf_dir):
    return layout.edge_relaxations(_misses(spark, sf_dir))


@query(_MISSES + f"select plan_id, cast(sum(greatest(0, need - covered)) as bigint) as lacking, cast(sum(case when covered >= need then 0 when n < need then {layout.NO_ZONE} else least_sum end) as double) as missed from r group by plan_id")
def l27_edge_score(spark, sf_dir):
    return layout.edge_score(_misses(spark, sf_dir))
