"""Solutions drawn over their source drawings, and a sink for drawings.

Zones and bars become entities as rows, entities become text by drawing, and the text is put into the source before the end of
its entities; all else of the source stays as it is, character for character. The sink writes one file a row from many tasks;
a file counts once the run's marker, which the driver writes last, names the folder of the attempt that wrote it.

Drawings of a version before AC1012, or of no version, get polylines of vertices; newer ones get light polylines, subclass
marks, and handles from the source's seed, which moves on.

Defined results. A drawing with a problem (see export_problems) keeps its problem and has no content. A null rectangle is not
drawn; null diameters, steps and labels are left out. Zones and bars of drawings that are not in the source are ignored, other
columns too. Empty tables give no rows and a run without files. Repeated drawing ids are an error of the caller: each gets the
entities of all. One drawing is one row, so its text and its entities have to fit in a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: the application of the marks, layers by kind with their colours (null: that of the class).
APPLICATION, LABELS = "REBAR_OPT", "RB_LABEL"
COLORS = {"PRIMARY": 8, "ZONE": None, "ZONE_ANCH": 2, "BAR": None, "ANCH": 1}
#: Metres in a millimetre; the label's distance above its zone in millimetres.
SCALE, ABOVE = 0.001, 150.0
_EOL = r"[ \t]*\r?\n"
_LINE = r"(?:\A|(?<=\n))[ \t]*"


def export_problems(sources: DataFrame, fitted: DataFrame, summaries: DataFrame) -> DataFrame:
    """What keeps the solution of each source (drawing_id, kind, content) from being drawn: `kind` if it is no drawing, `content`
    if that is missing or empty, `zones` if it has no fitted or no summarised zones, `number` if these differ in number, else null."""
    counted = lambda df, name: df.groupBy("drawing_id").agg(F.count(F.lit(1)).alias(name))
    met = sources.select("drawing_id", "kind", "content").join(counted(fitted, "fitted"), "drawing_id", "left").join(counted(summaries, "summarised"), "drawing_id", "left")
    problem = F.when(~F.col("kind").eqNullSafe("dxf"), "kind").when(F.coalesce(F.length("content"), F.lit(0)) == 0, "content")
    problem = problem.when(F.col("fitted").isNull() | F.col("summarised").isNull(), "zones").when(F.col("fitted") != F.col("summarised"), "number")
    return met.select("drawing_id", problem.alias("problem"))


def file_name(source: Column, n: Column) -> Column:
    """The name of a drawing with n zones, from its source's without folder, ending and characters that files must not have."""
    base = F.regexp_extract(F.coalesce(source, F.lit("")), r"([^/]*)$", 1)
    stem = F.trim(F.regexp_replace(F.trim(F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")), r'[<>:"/\\|?*]', ""))
    return F.concat(F.when(stem == "", "source").otherwise(stem), F.lit("_N"), n.cast("string"), F.lit("_rebar.dxf"))


def solution_entities(zones: DataFrame, bars: DataFrame, pieces: DataFrame) -> DataFrame:
    """What is drawn of each zone: drawing_id, zone, part, bar, kind, layer, color, points (array of x, y in metres), text, marks.

    zones: drawing_id, n, zone, cls, diameter, step, label, and the structs x0, y0, x1, y1 primary, final and anchored.
    bars: drawing_id, zone, bar, x, y0, y1. pieces, what anchorage adds to bars: drawing_id, zone, bar, x, low, high."""
    cls = F.col("cls").cast("string")
    color = 1 + F.pmod(F.abs("cls") * 2, F.lit(6))
    point = lambda x, y: F.struct((x * SCALE).cast("double").alias("x"), (y * SCALE).cast("double").alias("y"))
    corners = lambda r: F.array(*(point(F.col(f"{r}.{x}"), F.col(f"{r}.{y}")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    said = lambda kind, *more: F.filter(F.array(*(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in (("N", F.col("n")), ("ZONE", F.col("zone")), ("CLASS", F.col("cls")), ("KIND", F.lit(kind)), *more))), lambda t: t.isNotNull())

    def drawn(kind: str, part: int, points: Column, text: Column | None = None, bar: Column | None = None, *more) -> Column:
        own = COLORS.get(kind)
        layer = F.lit(LABELS) if kind == "LABEL" else F.concat(F.lit("RB_C"), cls, F.lit(f"_{kind}"))
        shade = F.lit(7) if kind == "LABEL" else color if own is None else F.lit(own)
        none = F.lit(None)
        return F.struct(F.lit(part).alias("part"), (none if bar is None else bar).cast("long").alias("bar"), F.lit(kind).alias("kind"), layer.alias("layer"), shade.cast("int").alias("color"),
                        points.alias("points"), (none if text is None else text).cast("string").alias("text"), said(kind, *more).alias("marks"))

    shapes = [F.when(F.col(r).isNotNull(), drawn(kind, k, corners(r))) for k, (kind, r) in enumerate((("PRIMARY", "primary"), ("ZONE", "final"), ("ZONE_ANCH", "anchored")))]
    label = drawn("LABEL", 5, F.array(point(F.col("final.x0"), F.col("final.y1") + ABOVE)), F.coalesce("label", F.lit("")), None, ("DIAMETER", F.col("diameter")), ("STEP", F.col("step")))
    whole = zones.select("drawing_id", "zone", F.explode(F.filter(F.array(*shapes, F.when(F.col("final").isNotNull(), label)), lambda e: e.isNotNull())).alias("e"))
    own = zones.select("drawing_id", "zone", "n", "cls")
    line = lambda kind, part, low, high: drawn(kind, part, F.array(point(F.col("x"), F.col(low)), point(F.col("x"), F.col(high))), None, F.col("bar"), ("BAR", F.col("bar")))
    stands = bars.select("drawing_id", "zone", "bar", "x", "y0", "y1").join(own.hint("merge"), ["drawing_id", "zone"]).select("drawing_id", "zone", line("BAR", 3, "y0", "y1").alias("e"))
    beyond = pieces.select("drawing_id", "zone", "bar", "x", "low", "high").join(own.hint("merge"), ["drawing_id", "zone"]).select("drawing_id", "zone", line("ANCH", 4, "low", "high").alias("e"))
    return whole.unionByName(stands).unionByName(beyond).select("drawing_id", "zone", "e.*")


def _number(v: Column) -> Column:
    """Nine digits after the point at most, no exponent."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", v), r"(?<=[0-9])0+$", ""), r"^-0\.$", "0.")


def _pairs(*pairs: tuple[int, Column | str]) -> Column:
    return F.concat(*(F.concat(F.lit(f"{code}\n"), F.lit(v) if isinstance(v, str) else v, F.lit("\n")) for code, v in pairs))


def _drawn_text(modern: bool) -> Column:
    """The text of one entity; newer drawings have its handle in the column handle."""
    mark = lambda name: _pairs((100, name)) if modern else F.lit("")
    head = lambda kind: F.concat(_pairs((0, kind)), _pairs((5, F.hex("handle"))) if modern else F.lit(""), mark("AcDbEntity"), _pairs((8, F.col("layer"))))
    at = lambda p, k: _pairs((10 + k, _number(p["x"])), (20 + k, _number(p["y"])))
    each = lambda f: F.array_join(F.transform("points", f), "")
    said = F.concat(_pairs((1001, APPLICATION)), F.array_join(F.transform("marks", lambda m: F.concat(F.lit("1000\n"), m, F.lit("\n"))), ""))
    if modern:
        outline = F.concat(head("LWPOLYLINE"), mark("AcDbPolyline"), _pairs((90, F.size("points").cast("string")), (70, "1")), each(lambda p: at(p, 0)), said)
    else:
        vertex = lambda p: F.concat(_pairs((0, "VERTEX"), (8, F.col("layer"))), at(p, 0))
        outline = F.concat(head("POLYLINE"), _pairs((66, "1"), (10, "0.0"), (20, "0.0"), (30, "0.0"), (70, "1")), said, each(vertex), _pairs((0, "SEQEND"), (8, F.col("layer"))))
    line = F.concat(head("LINE"), mark("AcDbLine"), at(F.col("points")[0], 0), at(F.get("points", F.lit(1)), 1), said)
    text = F.concat(head("TEXT"), mark("AcDbText"), at(F.col("points")[0], 0), _pairs((40, _number(F.col("height"))), (1, F.regexp_replace("text", r"[\r\n]+", " "))), mark("AcDbText"), said)
    return F.when(F.col("kind") == "LABEL", text).when(F.size("points") == 2, line).otherwise(outline)


def _heights(entities: DataFrame) -> DataFrame:
    """entities with height, of labels by their zone's size, from 3 to 15 cm."""
    zone = Window.partitionBy("drawing_id", "zone")
    span = lambda c: F.max(F.when(F.col("kind") == "ZONE", F.array_max(F.col("points")[c]) - F.array_min(F.col("points")[c]))).over(zone)
    return entities.withColumn("height", F.greatest(F.lit(0.03), F.least(F.lit(0.15), F.greatest(span("x"), span("y")) * 0.025)))


def _split(content: Column, start: str, end: str) -> tuple[Column, Column]:
    """content up to the first end after start, and the rest; the first is empty where they are missing."""
    head = F.regexp_extract(content, rf"(?s)\A(.*?{start and start + '.*?'})(?={end})", 1)
    return head, F.substr(content, F.length(head) + 1)


def _section(name: str) -> str:
    return rf"{_LINE}0{_EOL}[ \t]*SECTION{_EOL}[ \t]*2{_EOL}[ \t]*{name}{_EOL}"


def _ends(what: str) -> str:
    return rf"{_LINE}0{_EOL}[ \t]*{what}"


def _with_table(content: Column, name: str, records: Column) -> Column:
    """content with records at the end of a table, which is made in the section of tables, itself made if it is missing."""
    table = rf"{_LINE}0{_EOL}[ \t]*TABLE{_EOL}[ \t]*2{_EOL}[ \t]*{name}{_EOL}"
    made = F.concat(_pairs((0, "TABLE"), (2, name)), records, _pairs((0, "ENDTAB")))
    inside, inside_rest = _split(content, table, _ends("ENDTAB"))
    tables, tables_rest = _split(content, _section("TABLES"), _ends("ENDSEC"))
    before, before_rest = _split(content, "", rf"(?:{_section('BLOCKS')}|{_section('ENTITIES')})")
    alone = F.concat(_pairs((0, "SECTION"), (2, "TABLES")), made, _pairs((0, "ENDSEC")))
    return F.when(inside != "", F.concat(inside, records, inside_rest)).when(tables != "", F.concat(tables, made, tables_rest)).otherwise(F.concat(before, alone, before_rest))


def overlaid(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Sources (drawing_id, content) with entities drawn in, layers and application named: drawing_id, content, problem, which is
    `entities` where the source has no section for them."""
    seed = rf"(?<=\n)[ \t]*\$HANDSEED{_EOL}[ \t]*5{_EOL}[ \t]*([0-9A-Fa-f]+)"
    version = F.regexp_extract("content", rf"(?<=\n)[ \t]*\$ACADVER{_EOL}[ \t]*1{_EOL}[ \t]*(AC[0-9]+)", 1)
    first = F.conv(F.nullif(F.regexp_extract("content", seed, 1), F.lit("")), 16, 10).cast("long")
    known = sources.select("drawing_id", "content", (version >= "AC1012").alias("modern"), F.coalesce(first, F.lit(1 << 32)).alias("seed"))
    order = Window.partitionBy("drawing_id").orderBy("zone", "part", F.col("bar").asc_nulls_first(), F.col("points")[0]["y"], F.col("points")[0]["x"])
    placed = _heights(entities).withColumn("k", F.row_number().over(order)).join(known.select("drawing_id", "modern", "seed").hint("merge"), "drawing_id").withColumn("handle", F.col("seed") + F.col("k") - 1)
    shown = placed.select("drawing_id", "k", "layer", "color", F.when(F.col("modern"), _drawn_text(True)).otherwise(_drawn_text(False)).alias("t"))
    sorted_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda e: e["t"]), "")
    drawn = shown.groupBy("drawing_id").agg(sorted_text.alias("drawn"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.struct("layer", "color"))).alias("layers"))
    met = known.join(drawn.hint("merge"), "drawing_id", "left")
    named = lambda kind, name, *more: F.concat(F.lit(f"0\n{kind}\n"), F.when(F.col("modern"), F.concat(F.lit("5\n"), F.hex("next"), F.lit(f"\n100\nAcDbSymbolTableRecord\n100\nAcDb{'LayerTableRecord' if kind == 'LAYER' else 'RegAppTableRecord'}\n"))).otherwise(F.lit("")), F.lit("2\n"), name, F.lit("\n70\n0\n"), *more)
    met = met.withColumn("layers", F.filter("layers", lambda e: ~F.contains(F.regexp_replace("content", r"[ \t]*\r?\n", "\n"), F.concat(F.lit("\n2\n"), e["layer"], F.lit("\n")))))
    handle = lambda i: F.hex(F.col("seed") + F.col("n") + i)
    layer = lambda e, i: F.concat(F.lit("0\nLAYER\n"), F.when(F.col("modern"), F.concat(F.lit("5\n"), handle(i), F.lit("\n100\nAcDbSymbolTableRecord\n100\nAcDbLayerTableRecord\n"))).otherwise(F.lit("")), F.lit("2\n"), e["layer"], F.lit("\n70\n0\n62\n"), e["color"].cast("string"), F.lit("\n6\nCONTINUOUS\n"))
    met = met.withColumn("next", F.col("seed") + F.col("n") + F.size("layers"))
    application = F.when(F.contains(F.regexp_replace("content", r"[ \t]*\r?\n", "\n"), F.lit(f"\n2\n{APPLICATION}\n")), "").otherwise(named("APPID", F.lit(APPLICATION)))
    body, end = _split(F.col("full"), _section("ENTITIES"), _ends("ENDSEC"))
    known_body, _ = _split(F.col("content"), _section("ENTITIES"), _ends("ENDSEC"))
    met = met.withColumn("problem", F.when(F.coalesce(known_body, F.lit("")) == "", "entities"))
    met = met.withColumn("layer_text", F.array_join(F.transform("layers", layer), "")).withColumn("application", application)
    met = met.withColumn("full", _with_table(F.col("content"), "LAYER", F.col("layer_text")))
    met = met.withColumn("full", _with_table(F.col("full"), "APPID", F.col("application")))
    moved, rest = _split(F.col("full"), rf"(?<=\n)[ \t]*\$HANDSEED{_EOL}[ \t]*5{_EOL}", r"[ \t]*[0-9A-Fa-f]+")
    met = met.withColumn("full", F.when(moved != "", F.concat(moved, F.hex(F.col("next") + 1), F.regexp_replace(rest, r"\A[ \t]*[0-9A-Fa-f]+", ""))).otherwise(F.col("full")))
    met = met.withColumns({"body": body, "end": end})  # entities come last, so that nothing above is sought in their text
    met = met.withColumn("full", F.concat("body", "drawn", "end"))
    out = F.when(F.col("problem").isNull(), F.when(F.col("drawn").isNull(), F.col("content")).otherwise(F.col("full")))
    return met.select("drawing_id", out.alias("content"), "problem")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class _Written(WriterCommitMessage):
    """The folder of one task's attempt."""

    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.encoding, self.overwrite = options["path"].rstrip("/"), options.get("encoding", "utf-8"), overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, at = _opened(self.path)
        folder, seen = f"{self.run}/{uuid.uuid4().hex}", {}
        for row in iterator:
            if row.content is None:
                continue
            if not seen:
                files.create_dir(f"{at}/{folder}", recursive=True)
            seen[row.name] = seen.get(row.name, 0) + 1
            name = row.name if seen[row.name] == 1 else f"{seen[row.name]}_{row.name}"
            with files.open_output_stream(f"{at}/{folder}/{name}") as out:
                out.write(row.content.encode(self.encoding))
        return _Written(folder, sum(seen.values()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, at = _opened(self.path)
        files.create_dir(f"{at}/_committed", recursive=True)
        old = files.get_file_info(fs.FileSelector(f"{at}/_committed")) if self.overwrite else []
        with files.open_output_stream(f"{at}/_writing-{self.run}") as out:
            out.write("".join(f"{m.folder}\n" for m in messages if m and m.files).encode())
        files.move(f"{at}/_writing-{self.run}", f"{at}/_committed/{self.run}")
        for marker in old:
            files.delete_file(marker.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = _opened(self.path)
        for m in messages:
            if m and m.files:
                files.delete_dir(f"{at}/{m.folder}")


class DrawingSink(DataSource):
    """`df.write.format("drawings").mode("append").save(uri)` for rows (name, content); rows without content write nothing. The
    option encoding names the files' code page; mode overwrite makes this run the only one that counts."""

    @classmethod
    def name(cls) -> str:
        return "drawings"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if missing := {"name", "content"} - set(schema.names):
            raise ValueError(f"a drawing needs the columns {sorted(missing)}")
        return _Writer(dict(self.options), overwrite)


def save(drawings: DataFrame, uri: str, mode: str = "append", encoding: str = "utf-8") -> None:
    """Writes drawings (name, content) below uri, one file each."""
    drawings.sparkSession.dataSource.register(DrawingSink)
    drawings.select("name", "content").write.format("drawings").mode(mode).option("encoding", encoding).save(uri)


def saved(spark: SparkSession, uri: str, encoding: str = "UTF-8") -> DataFrame:
    """The drawings of all committed runs below uri: drawing_id (the file), content. A run has one folder a task."""
    uri = uri.rstrip("/")
    folders = [f"{uri}/{r.value}" for r in spark.read.text(f"{uri}/_committed").where("value <> ''").collect()]
    if not folders:
        return spark.createDataFrame([], "drawing_id string, content string")
    files = spark.read.format("binaryFile").load(folders)
    return files.select(F.col("path").alias("drawing_id"), F.decode("content", encoding).alias("content"))
