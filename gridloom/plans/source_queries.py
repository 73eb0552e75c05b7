"""Queries of payloads and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.plans.layout_queries import ZONES
from gridloom.sources import payloads


def _payloads(spark, sf_dir):
    """Each box as a payload: bare lists, objects in mm, objects in m."""
    b = fx.view(spark, sf_dir, fx.BOXES12)
    ring = lambda f: F.format_string("[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]", *((F.col(c) / f).cast("string") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")))
    one = lambda f: F.concat(F.lit('[{"points":'), ring(f), F.lit(',"load":'), F.col("load").cast("string"), F.lit("}]"))
    kind = F.col("poly_id") % 3
    text = F.when(kind == 0, one(1)).when(kind == 1, F.concat(F.lit('{"kind":"polygons","polygons":'), one(1), F.lit("}"))).otherwise(F.concat(F.lit('{"units":"m","polygons":'), one(1000), F.lit("}")))
    return b.select(F.col("poly_id").alias("plan_id"), text.alias("payload"))


@query(f"with b as ({fx.BOXES12}) select poly_id as plan_id, cast(0 as integer) as pos, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y1 as double) as y1, cast(load as double) as load from b")
def s01_normalise(spark, sf_dir):
    p = payloads.normalised_polygons(_payloads(spark, sf_dir))
    side = lambda f, c: F.round(f(F.transform("points", lambda q: q[c])), 6)
    return p.select("plan_id", "pos", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"), "load")


@query(f"with b as ({fx.BOXES12}) select poly_id as plan_id, cast((x1 - x0) * (y1 - y0) as double) as area, cast(null as varchar) as problem from b")
def s02_checked(spark, sf_dir):
    return payloads.checked(payloads.normalised_polygons(_payloads(spark, sf_dir))).select("plan_id", F.round("area", 3).alias("area"), "problem")


@query("select event_id, case when event_id % 7 = 0 or event_id % 5 = 0 then null else value end as value from events")
def s11_json_safe(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return e.select("event_id", payloads.json_safe(odd).alias("value"))


_BLOB = "select p_partkey as name, repeat(p_name || '-é' || p_type || ';', 3) as data from part"


@query(f"with b as ({_BLOB}) select name, i as part, hex(encode(data)[i * 20 + 1 : i * 20 + 20]) as data, octet_length(encode(data)) as bytes, sha256(data) as sha256 from (select *, unnest(generate_series(0, greatest(0, cast(ceil(octet_length(encode(data)) / 20.0) as bigint) - 1))) as i from b)")
def s16_chunks(spark, sf_dir):
    return payloads.chunks(fx.view(spark, sf_dir, _BLOB), 20).withColumn("data", F.hex("data"))


@query(f"with b as ({_BLOB}) select name, data, name % 3 <> 0 as ok from b where name % 3 <> 0 union all select name, left(data, 0), false from b where name % 3 = 0")
def s17_reassembled(spark, sf_dir):
    """Every third blob has lost its first chunk."""
    parts = payloads.chunks(fx.view(spark, sf_dir, _BLOB), 20).where("name % 3 <> 0 or part > 0")
    got = payloads.reassembled(parts)
    return got.select("name", F.when(F.col("ok"), F.decode("data", "UTF-8")).otherwise("").alias("data"), "ok")


@query("with r as (select l_orderkey as task_id, l_quantity as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as k from lineitem), f as (select task_id, cast(q as bigint) as n, min(k) as k from r group by task_id, cast(q as bigint)) select task_id, row_number() over (partition by task_id order by k) - 1 as pos, n from f")
def t24_distinct_numbers(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    ns = l.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("n")))).alias("a"))
    return payloads.distinct_numbers(ns.select("task_id", F.transform("a", lambda x: x["n"]).alias("ns")))


_NAMES = "select o_orderkey as job_id, case o_orderkey % 10 when 0 then ' CBC' when 1 then 'PULP-CBC-CMD' when 2 then 'HiGHS ' when 3 then 'other' when 4 then 'coin_cmd' when 5 then 'highs-cmd' when 6 then 'highspy' when 7 then 'Coin' when 8 then '' end as name from orders"


@query(f"select job_id, case job_id % 10 when 3 then null when 2 then 'highs' when 5 then 'highs' when 6 then 'highs' else 'cbc' end as solver from ({_NAMES})")
def x20_solver_name(spark, sf_dir):
    return fx.view(spark, sf_dir, _NAMES).select("job_id", payloads.solver_name(F.col("name")).alias("solver"))


_LABELLED = f"select plan_id, zone_id, cls, case when zone_id % 7 = 0 then null else cast(diameter as double) end as diameter, step * 1.25 as step, (x1 - x0) * 1000.0 / 7 as width, (y1 - y0) * 997.0 as length, case when zone_id % 5 = 0 then null else (x1 - x0) * 0.37 end as mass, (x1 - x0) * 0.41 as anchored_mass from ({ZONES})"


@query(
    f"with z as ({_LABELLED}) select plan_id, zone_id, 'N=' || count(*) over (partition by plan_id) || ' | ZONE=' || row_number() over (partition by plan_id order by zone_id) || ' | CLASS=' || cls || case when diameter is null then '' else ' | D=' || format('{{:g}}', diameter) || 'mm' end || ' | STEP=' || format('{{:g}}', cast(step as double)) || 'mm | W=' || format('{{:g}}', cast(width as double)) || "
    "'mm | L=' || format('{:g}', cast(length as double)) || 'mm' || case when mass is null then '' else ' | M=' || format('{:.2f}', cast(mass as double)) || 'kg' end || ' | M+ANCH=' || format('{:.2f}', cast(anchored_mass as double)) || 'kg' as label from z"
)
def s09_zone_labels(spark, sf_dir):
    return payloads.zone_labels(fx.view(spark, sf_dir, _LABELLED))
