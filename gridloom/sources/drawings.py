"""Load polygons from ASCII drawings of group codes and values, by DataFrame functions.

A drawing is one row (drawing_id, content); its lines are paired and cut into entities without a shuffle, and entities then
spread over the cluster. Only the order of an entity in its own drawing needs a window.

Defined results. A null, empty or odd-lined content gives what its whole pairs hold. A face whose colour the scale lacks, or
whose label is no number, has a null load. Repeated colours take the label of the last one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format: the block and layer of the load map, the layer of its colour scale, units in a millimetre.
BLOCK, SCALE, UNIT = "KLEENKA", "COLORSCALE", 1000.0


def read_drawings(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """drawing_id (the path) and content of each drawing below a path, decoded from its bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("drawing_id"), F.decode("content", encoding).alias("content"))


def entities(drawings: DataFrame) -> DataFrame:
    """drawing_id, at, kind and pairs (array of code, value) of all that begins with code 0, in the order of the file."""
    lines = F.split(F.coalesce("content", F.lit("")), r"\r?\n")
    paired = drawings.select("drawing_id", lines.alias("l"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1), lambda i: F.struct(F.trim(F.get("l", 2 * i)).try_cast("int").alias("code"), F.trim(F.get("l", 2 * i + 1)).alias("value")))
    paired = paired.select("drawing_id", F.when(F.size("l") >= 2, each).alias("p"))
    starts = F.filter(F.transform("p", lambda e, i: F.when(e["code"] == 0, i + 1)), lambda i: i.isNotNull())
    cut = paired.withColumn("s", starts)
    whole = F.transform("s", lambda s, i: F.slice("p", s, F.coalesce(F.get("s", i + 1), F.size("p") + 1) - s))
    # no filter before the rows are made: it would go down to what made the text, and make each text again as often as it is named
    each_one = cut.select("drawing_id", F.posexplode_outer(whole).alias("at", "pairs")).where("pairs is not null")
    return each_one.select("drawing_id", "at", F.col("pairs")[0]["value"].alias("kind"), "pairs")


def _value(code: int) -> Column:
    return F.get(F.filter("pairs", lambda e: e["code"] == code), F.lit(0))["value"]


def _number(code: int) -> Column:
    return _value(code).try_cast("double")


def load_polygons(drawings: DataFrame) -> DataFrame:
    """The faces of each drawing's load map, in order: drawing_id, poly_id, points (array of x, y in millimetres), color, load."""
    order = Window.partitionBy("drawing_id").orderBy("at")
    marks = F.when(F.col("kind") == "SECTION", F.struct(_value(2).alias("section"), F.lit(None).cast("string").alias("block")))
    marks = marks.when(F.col("kind") == "BLOCK", F.struct(F.lit("BLOCKS").alias("section"), _value(2).alias("block"))).when(F.col("kind").isin("ENDSEC", "ENDBLK"), F.struct(F.lit("").alias("section"), F.lit(None).cast("string").alias("block")))
    near = entities(drawings).where(F.col("kind").isin("SECTION", "ENDSEC", "BLOCK", "ENDBLK", "SOLID", "INSERT", "ATTRIB", "3DFACE"))
    near = near.withColumn("within", F.last(marks, ignorenulls=True).over(order)).withColumn("insert", F.last(F.when(F.col("kind") == "INSERT", _value(2)), ignorenulls=True).over(order))
    mine = F.coalesce(_value(8), F.lit("0"))
    drawn = (F.col("within.section") == "ENTITIES") & (F.coalesce(_value(67), F.lit("0")) != "1")
    color = F.coalesce(_value(62).try_cast("int"), F.lit(256))
    points = F.array(*(F.struct((_number(10 + i) * UNIT).alias("x"), (_number(20 + i) * UNIT).alias("y")) for i in range(4)))
    rank = lambda by: F.row_number().over(Window.partitionBy("drawing_id").orderBy(by, "at"))
    scale = near.where((F.col("kind") == "SOLID") & (F.col("within.block") == BLOCK) & (mine == SCALE))
    scale = scale.select("drawing_id", "at", color.alias("color"), sum((_number(10 + i) for i in range(1, 4)), _number(10)).alias("x")).select("drawing_id", "color", rank("x").alias("k"))
    labels = near.where((F.col("kind") == "ATTRIB") & (F.col("insert") == BLOCK) & drawn)
    labels = labels.select("drawing_id", "at", _value(1).try_cast("double").alias("text"), F.coalesce(_number(11), _number(10)).alias("x")).select("drawing_id", "text", (rank("x") - 1).alias("k"))
    loads = scale.join(labels, ["drawing_id", "k"]).groupBy("drawing_id", "color").agg(F.max(F.struct("k", (F.col("text") - 1).alias("load")))["load"].alias("load"))
    faces = near.where((F.col("kind") == "3DFACE") & (mine == BLOCK) & drawn).select("drawing_id", "at", points.alias("points"), color.alias("color"))
    faces = faces.withColumn("poly_id", (rank("at") - 1).cast("long")).drop("at")
    return faces.join(loads, ["drawing_id", "color"], "left").select("drawing_id", "poly_id", "points", "color", "load")
