"""Queries of drawings: one drawing a plan, with a colour scale, its labels and a face for each part; and solutions drawn over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import layout
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.plans.layout_queries import ZONES
from gridloom.sources import drawing_output, drawings, payloads


def _text(*pairs) -> str:
    return "".join(f"{code}\n{value}\n" for code, value in pairs)


def _scale() -> str:
    """Colours 1 to 5 from right to left, labels from left to right: the first is a title, the k-th after it says 10 k - 9."""
    solids = "".join(_text((0, "SOLID"), (8, "COLORSCALE"), (62, c), *((10 + i, 60 - 10 * c) for i in range(4)), *((20 + i, 0) for i in range(4))) for c in range(1, 6))
    labels = "".join(_text((0, "ATTRIB"), (8, "0"), (10, 900 - k), (20, 0), (1, 10 * k - 9 if k else -5), (11, k), (21, 0)) for k in (3, 0, 5, 1, 4, 2))
    head = _text((0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "KLEENKA")) + solids + _text((0, "ENDBLK"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))
    return head + _text((0, "INSERT"), (2, "KLEENKA"), (66, 1)) + labels + _text((0, "SEQEND"))


def _drawings(spark, sf_dir):
    """One drawing a plan, with a face for each part: drawing_id, content."""
    corner = lambda x, y, i: F.concat(F.lit(f"{10 + i}\n"), (F.col(x) / 1000).cast("string"), F.lit(f"\n{20 + i}\n"), (F.col(y) / 1000).cast("string"), F.lit("\n"))
    face = F.concat(F.lit("0\n3DFACE\n8\nKLEENKA\n62\n"), F.expr("cast(cast(1 + load / 10 as int) as string)"), F.lit("\n"), *(corner(x, y, i) for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))))
    made = fx.dealt(spark, sf_dir, fx.BOXES12).groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("poly_id", face.alias("f")))), lambda s: s["f"]), "").alias("faces"))
    scale = F.when(F.col("plan_id") % 4 == 0, F.lit(_scale().replace("62\n5\n", "62\n7\n"))).otherwise(F.lit(_scale()))
    text = F.concat(scale, F.col("faces"), F.lit("0\nENDSEC\n0\nEOF\n"))
    return made.select(F.col("plan_id").alias("drawing_id"), F.when(F.col("plan_id") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).alias("content"))


@query(f"""select plan_id as drawing_id, row_number() over (partition by plan_id order by poly_id) - 1 as poly_id, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y1 as double) as y1,
 cast(1 + load / 10 as int) as color, case when load < 40 or plan_id % 4 > 0 then cast(40 - load as double) end as load from ({fx.BOXES12}) as b""")
def s03_drawings(spark, sf_dir):
    got = drawings.load_polygons(_drawings(spark, sf_dir))
    at = lambda i, c: F.expr(f"round(points[{i}].{c}, 6)")
    return got.select("drawing_id", "poly_id", at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(2, "x").alias("x1"), at(2, "y").alias("y1"), "color", "load")


_SOLUTION = f"with z as (select *, x0 + ceil((x1 - x0) / step) * step as right from ({ZONES})), bars as (select *, unnest(generate_series(0, cast(round_even((x1 - x0) / step, 0) as bigint))) as bar from z)"


@query(
    f"{_SOLUTION}, e as (select plan_id, 'LWPOLYLINE' as kind, 'RB_C' || cls || '_' || unnest(['PRIMARY', 'ZONE', 'ZONE_ANCH']) as layer, cast(null as double) as low, cast(null as double) as high from z "
    "union all select plan_id, 'TEXT', 'RB_LABEL', null, null from z union all select plan_id, '3DFACE', 'KLEENKA', null, null from z union all select plan_id, 'LINE', 'RB_C' || cls || '_BAR', y0, y1 from bars "
    "union all select plan_id, 'LINE', 'RB_C' || cls || '_ANCH', unnest([y0 - hold, y1]), unnest([y0, y1 + hold]) from bars) "
    "select plan_id as drawing_id, kind, layer, count(*) as n, cast(min(low) as double) as low, cast(max(high) as double) as high from e group by all"
)
def s07_overlaid(spark, sf_dir):
    z = fx.dealt(spark, sf_dir, ZONES).withColumn("right", F.col("x0") + F.ceil((F.col("x1") - F.col("x0")) / F.col("step")) * F.col("step"))
    told = z.select("plan_id", "zone_id", "cls", "diameter", "step", (F.col("right") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("length"), F.lit(None).cast("double").alias("mass"), F.lit(None).cast("double").alias("anchored_mass"))
    z = z.join(payloads.zone_labels(told).hint("merge"), ["plan_id", "zone_id"])
    rect = lambda y0, y1, x1="right": F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in (("x0", "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))
    shaped = z.select(F.col("plan_id").alias("drawing_id"), F.count(F.lit(1)).over(Window.partitionBy("plan_id")).alias("n"), F.col("zone_id").alias("zone"), "cls", F.col("diameter").cast("double").alias("diameter"), F.col("step").cast("double").alias("step"), "label",
                      rect("y0", "y1", "x1").alias("primary"), rect("y0", "y1").alias("final"), rect(F.col("y0") - F.col("hold"), F.col("y1") + F.col("hold")).alias("anchored"))
    bars = layout.positions(z).join(z.select("plan_id", "zone_id", "hold").hint("merge"), ["plan_id", "zone_id"])
    pieces = layout.anchorage_pieces(bars.withColumns({"a0": F.col("y0") - F.col("hold"), "a1": F.col("y1") + F.col("hold")})).join(bars.select("plan_id", "zone_id", "bar", "x").hint("merge"), ["plan_id", "zone_id", "bar"])
    named = {"plan_id": "drawing_id", "zone_id": "zone"}
    header = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1027\n9\n$HANDSEED\n5\n2F\n0\nENDSEC\n"
    sources = _drawings(spark, sf_dir).withColumn("content", F.when(F.col("drawing_id") % 3 == 0, F.concat(F.lit(header), "content")).otherwise(F.col("content")))
    drawn = drawing_output.overlaid(sources, drawing_output.solution_entities(shaped, bars.withColumnsRenamed(named), pieces.withColumnsRenamed(named)))
    of = lambda code: F.get(F.filter("pairs", lambda e: e["code"] == code), F.lit(0))["value"]
    line = lambda code: F.when(F.col("kind") == "LINE", F.round(of(code).cast("double") * 1000, 3))
    seen = drawings.entities(drawn).where("kind in ('LWPOLYLINE', 'POLYLINE', 'LINE', 'TEXT', '3DFACE')")
    return seen.groupBy("drawing_id", F.regexp_replace("kind", "^POLY", "LWPOLY").alias("kind"), of(8).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.min(line(20)).alias("low"), F.max(line(21)).alias("high"))


_SENT = f"select distinct plan_id as drawing_id, case when plan_id % 5 = 1 then 'polygons' when plan_id % 5 = 2 then null else 'dxf' end as kind, case when plan_id % 7 = 0 then '' when plan_id % 7 = 1 then null else 'x' end as content from ({fx.BOXES12})"
_FITTED = f"select plan_id as drawing_id, poly_id as zone from ({fx.BOXES12}) where plan_id % 11 > 0"
_SUMMARISED = f"select plan_id as drawing_id, poly_id as zone from ({fx.BOXES12}) where plan_id % 3 > 0 or poly_id % 12 > 0"


@query(
    f"with s as ({_SENT}), f as (select drawing_id, count(*) as n from ({_FITTED}) group by all), m as (select drawing_id, count(*) as n from ({_SUMMARISED}) group by all) select s.drawing_id, "
    "case when kind is distinct from 'dxf' then 'kind' when coalesce(content, '') = '' then 'content' when f.n is null or m.n is null then 'zones' when f.n <> m.n then 'number' end as problem from s left join f on f.drawing_id = s.drawing_id left join m on m.drawing_id = s.drawing_id"
)
def s10_export_problems(spark, sf_dir):
    return drawing_output.export_problems(*(fx.view(spark, sf_dir, sql) for sql in (_SENT, _FITTED, _SUMMARISED)))
