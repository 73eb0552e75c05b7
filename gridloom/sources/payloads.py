"""Payloads: polygon input as JSON, JSON-safe output, and blobs in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.raster import ring_area

_POINTS = "array<struct<points: array<array<double>>, load: double>>"


def normalised_polygons(payloads: DataFrame) -> DataFrame:
    """Polygons of payloads (plan_id, payload): plan_id, pos, points (struct x, y in mm), load.

    A payload is an object with polygons, its kind and units optional (mm by default), or a bare list of polygons."""
    whole = F.from_json("payload", f"struct<kind: string, units: string, polygons: {_POINTS}>")
    bare = F.from_json(F.concat(F.lit('{"polygons":'), F.col("payload"), F.lit("}")), f"struct<polygons: {_POINTS}>")
    is_list = F.ltrim("payload").startswith("[")
    got = payloads.select("plan_id", F.coalesce(F.when(~is_list, whole["units"]), F.lit("mm")).alias("units"), F.when(is_list, bare["polygons"]).otherwise(whole["polygons"]).alias("polygons"))
    rows = got.select("plan_id", "units", F.posexplode("polygons").alias("pos", "p"))
    factor = F.when(F.col("units") == "m", 1000.0).when(F.col("units") == "mm", 1.0).otherwise(F.raise_error(F.concat(F.lit("unknown units: "), "units")).cast("double"))
    return rows.withColumn("f", factor).select("plan_id", "pos", F.transform("p.points", lambda q: F.struct((q[0] * F.col("f")).alias("x"), (q[1] * F.col("f")).alias("y"))).alias("points"), F.col("p.load").alias("load"))


def checked(polygons: DataFrame) -> DataFrame:
    """Polygons with their area; fewer than three points, no area or a negative load is an error told in `problem`."""
    area = ring_area(F.col("points"))
    problem = F.when(F.size("points") < 3, F.lit("points")).when(area <= 0, F.lit("area")).when((F.col("load") < 0) | F.col("load").isNull(), F.lit("load"))
    return polygons.withColumns({"area": area, "problem": problem})


def json_safe(value: Column) -> Column:
    """A number that JSON can hold: null for what is not finite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def chunks(blobs: DataFrame, size: int) -> DataFrame:
    """Blobs (name, data as text or bytes) in chunks of size bytes: name, part, data (binary), and of the whole its bytes and
    sha256. An empty blob has one empty chunk; a null one counts as empty."""
    rows = blobs.select("name", F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("data") / size).cast("int") - 1))
    rows = rows.select("name", "data", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"), F.explode(parts).alias("part"))
    return rows.select("name", "part", F.substring(F.col("data"), F.col("part") * size + 1, F.lit(size)).alias("data"), "bytes", "sha256")


def reassembled(parts: DataFrame) -> DataFrame:
    """Blobs from their chunks, with whether size and digest are right; a missing or a stale chunk makes them wrong."""
    got = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("p"), F.first("bytes").alias("bytes"), F.first("sha256").alias("sha256"))
    data = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["data"]))
    return got.select("name", data.alias("data"), ((F.octet_length(data) == F.col("bytes")) & (F.sha2(data, 256) == F.col("sha256"))).alias("ok"))


def distinct_numbers(requests: DataFrame) -> DataFrame:
    """Requested numbers (task_id, ns) in the order of their first mention: task_id, pos, n."""
    return requests.select("task_id", F.posexplode(F.array_distinct("ns")).alias("pos", "n")).withColumn("pos", F.col("pos").cast("long"))


#: Other names of the two solvers.
ALIASES = {"coin": "cbc", "coin_cmd": "cbc", "pulp_cbc_cmd": "cbc", "highs_cmd": "highs", "highspy": "highs"}


def solver_name(name: Column, strict: bool = False) -> Column:
    """The canonical name of a solver: cbc for null or an empty name, aliases in either case, with hyphens or underscores.
    Of an unknown name null, or an error if strict."""
    low = F.replace(F.lower(F.trim(F.when(F.coalesce(name, F.lit("")) == "", "cbc").otherwise(name))), F.lit("-"), F.lit("_"))
    known = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), low), low)
    unknown = F.raise_error(F.concat(F.lit("unknown solver: "), low)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(known.isin("cbc", "highs"), known).otherwise(unknown)


def short_number(v: Column) -> Column:
    """A finite number in six significant digits without trailing zeros, with an exponent below -4 or from 6 on."""
    sci = F.format_string("%.5e", v.cast("double"))
    power = F.split_part(sci, F.lit("e"), F.lit(2)).cast("int")
    trimmed = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    plain = sci.cast("decimal(38,12)").cast("string")
    return F.when((power >= -4) & (power < 6), trimmed(plain)).otherwise(F.concat(trimmed(F.split_part(sci, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(sci, F.lit("e"), F.lit(2))))


def zone_labels(zones: DataFrame) -> DataFrame:
    """A label for each zone (plan_id, zone_id, cls, diameter, step, width, length, mass, anchored_mass) that tells the plan's
    number of zones, the zone's place in it and what it is; parts that are null are left out."""
    order = Window.partitionBy("plan_id").orderBy("zone_id")
    n, place = F.count(F.lit(1)).over(Window.partitionBy("plan_id")), F.row_number().over(order)
    parts = [F.concat(F.lit(f"{name}="), v.cast("string")) for name, v in (("N", n), ("ZONE", place), ("CLASS", F.col("cls")))]
    parts += [F.concat(F.lit(f"{name}="), short_number(F.col(c)), F.lit("mm")) for name, c in (("D", "diameter"), ("STEP", "step"), ("W", "width"), ("L", "length"))]
    parts += [F.concat(F.lit(f"{name}="), F.format_string("%.2f", F.col(c).cast("double")), F.lit("kg")) for name, c in (("M", "mass"), ("M+ANCH", "anchored_mass"))]
    absent = [None] * 3 + ["diameter", "step", "width", "length", "mass", "anchored_mass"]
    return zones.select("plan_id", "zone_id", F.concat_ws(" | ", *(p if c is None else F.when(F.col(c).isNotNull(), p) for p, c in zip(parts, absent, strict=True))).alias("label"))
