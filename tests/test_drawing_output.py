"""Solutions drawn over drawings, written, and read back."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources import drawing_output as out
from gridloom.sources import drawings

RECT = "struct<x0: double, y0: double, x1: double, y1: double>"
ZONES = f"drawing_id long, n int, zone long, cls int, diameter double, step double, label string, primary {RECT}, final {RECT}, anchored {RECT}, layer int"
OLD = "0\nSECTION\n2\nENTITIES\n  0\nLINE\n8\nORIGINAL\n10\n0.0\n20\n0.0\n11\n10.0\n21\n0.0\n0\nENDSEC\n0\nEOF\n"
NEW = ("0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1032\n9\n$HANDSEED\n5\n2F\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n70\n1\n0\nLAYER\n2\nRB_C3_BAR\n70\n0\n62\n5\n0\nENDTAB\n0\nENDSEC\n" + OLD).replace("\n", "\r\n")


def pieces_of(text):
    lines = text.replace("\r\n", "\n").split("\n")
    out = []
    for code, value in zip(lines[::2], lines[1::2], strict=False):
        if int(code) == 0:
            out.append([value])
        out[-1].append((int(code), value.strip()))
    return out


def made(spark):
    z = (3, 25.0, 150.0, "N=30 | CLASS=3", (900.0, 1900.0, 2100.0, 5100.0), (1000.0, 2000.0, 2000.0, 5000.0), (1000.0, 1500.0, 2000.0, 5500.0), 0)
    zones = spark.createDataFrame([(1, 30, 0, *z), (2, 30, 0, *z), (2, 30, 1, 0, None, None, None, None, (0.0, 0.0, 0.0001, 1.0), None, 0)], ZONES)
    bars = spark.createDataFrame([(d, 0, b, 1000.0 * (b + 1), 2000.0, 5000.0) for d in (1, 2) for b in (0, 1)], "drawing_id long, zone long, bar long, x double, y0 double, y1 double")
    pieces = spark.createDataFrame([(d, 0, b, 1000.0 * (b + 1), *p) for d in (1, 2) for b in (0, 1) for p in ((1500.0, 2000.0), (5000.0, 5500.0))], "drawing_id long, zone long, bar long, x double, low double, high double")
    sources = spark.createDataFrame([(1, OLD, "a"), (2, NEW, "b"), (3, OLD, "c"), (4, "0\nEOF\n", "d"), (5, None, "e")], "drawing_id long, content string, layer string")
    return sources, out.solution_entities(zones, bars, pieces)


def test_source_stays_and_layers_come(spark):
    sources, entities = made(spark)
    got = {r.drawing_id: r for r in out.overlaid(sources, entities).collect()}
    assert [got[k].problem for k in range(1, 6)] == [None, None, None, "entities", "entities"]
    assert got[3].content == OLD and got[4].content is None and got[5].content is None
    for d, source in ((1, OLD), (2, NEW)):
        text, rest = got[d].content, pieces_of(got[d].content)
        left = list(pieces_of(source))
        for p in rest:  # the source's pieces are all there, in order
            if left and (p == left[0] or (p[0] == "SECTION" and p[:3] == left[0][:3])):
                left.pop(0)
        assert not left
        layers = [dict(p[1:])[2] for p in rest if p[0] == "LAYER"]
        want = {f"RB_C3_{k}" for k in ("PRIMARY", "ZONE", "ZONE_ANCH", "BAR", "ANCH")} | {"RB_LABEL"} | ({"RB_C0_ZONE"} if d == 2 else set())
        assert set(layers) == want and len(layers) == len(want)
        assert [dict(p[1:])[2] for p in rest if p[0] == "APPID"] == ["REBAR_OPT"]
        lines = [dict(p[1:]) for p in rest if p[0] == "LINE" and (8, "RB_C3_BAR") in p]
        assert [(e[10], e[20], e[11], e[21]) for e in lines] == [("1.0", "2.0", "1.0", "5.0"), ("2.0", "2.0", "2.0", "5.0")]
        assert [dict(p[1:])[21] for p in rest if p[0] == "LINE" and (8, "RB_C3_ANCH") in p] == ["2.0", "5.5", "2.0", "5.5"]
        labels = [dict(p[1:]) for p in rest if p[0] == "TEXT"]
        assert labels[0][1] == "N=30 | CLASS=3" and labels[0][40] == "0.075" and labels[0][20] == "5.15" and len(labels) == d
        assert text.index("RB_C3_PRIMARY\n70") < text.index("ENTITIES")
    assert {p[0] for p in pieces_of(got[1].content)} >= {"POLYLINE", "VERTEX", "SEQEND"}
    handles = [int(v, 16) for p in pieces_of(got[2].content) if p[0] not in ("SECTION",) for c, v in p[1:] if c == 5]
    assert len(handles) == len(set(handles)) and min(handles) == 0x2F
    assert int(dict(pieces_of(got[2].content)[0][1:])[5], 16) > max(handles)
    assert [v for p in pieces_of(got[2].content) if p[0] == "LWPOLYLINE" and (8, "RB_C0_ZONE") in p for c, v in p[1:] if c == 10] == ["0.0", "0.0000001", "0.0000001", "0.0"]


def test_files(spark, tmp_path):
    uri = f"file://{tmp_path}/drawn"
    sources, entities = made(spark)
    rows = out.overlaid(sources, entities).select(out.file_name(F.lit("dir/Верх: no.1.dxf"), F.lit(30)).alias("name"), "content", F.lit(1).alias("path"))
    out.save(rows.repartition(3), uri)
    want = sorted(r.content for r in rows.where("content is not null").collect())
    assert sorted(r.content for r in out.saved(spark, uri).collect()) == want and len(want) == 3
    assert all(r.drawing_id.endswith("_N30_rebar.dxf") for r in out.saved(spark, uri).collect())
    (tmp_path / "drawn" / "lost").mkdir()
    (tmp_path / "drawn" / "lost" / "x.dxf").write_text(OLD)  # of an attempt that no marker names
    out.save(rows, uri)
    assert out.saved(spark, uri).count() == 6
    out.save(rows.limit(0), uri, mode="overwrite")
    assert out.saved(spark, uri).count() == 0
    with pytest.raises(Exception, match="columns"):
        spark.range(1).write.format("drawings").mode("append").save(uri)
    broken = spark.range(40).repartition(4).selectExpr("'a.dxf' as name", "if(id = 39, cast(raise_error('gone') as string), 'x') as content")
    with pytest.raises(Exception, match="gone"):
        out.save(broken, uri)
    assert out.saved(spark, uri).count() == 0


def test_problems_and_names(spark):
    sources = spark.createDataFrame([(1, "dxf", "x"), (2, "polygons", "x"), (3, "dxf", ""), (4, "dxf", "x"), (5, "dxf", "x"), (6, None, "x")], "drawing_id long, kind string, content string")
    rows = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "drawing_id long, zone long")
    got = {r.drawing_id: r.problem for r in out.export_problems(sources, rows(1, 2, 3, 5, 5, 6), rows(1, 2, 3, 5, 6)).collect()}
    assert got == {1: None, 2: "kind", 3: "content", 4: "zones", 5: "number", 6: "kind"}
    names = spark.createDataFrame([("a/b.dxf",), (None,), ("?*.dxf",), (".dxf",), ("x.y.dxf",)], "s string").select(out.file_name(F.col("s"), F.lit(2)).alias("n"))
    assert [r.n for r in names.collect()] == ["b_N2_rebar.dxf", "source_N2_rebar.dxf", "source_N2_rebar.dxf", ".dxf_N2_rebar.dxf", "x.y_N2_rebar.dxf"]
    assert drawings.load_polygons(made(spark)[0]).count() == 0
