"""Drawings at their edges, and one read from a file."""

from pyspark.sql import functions as F

from gridloom.sources import drawings


def test_edges(spark, tmp_path):
    face = "0\nSECTION\n2\nENTITIES\n 0\n3DFACE\n8\nKLEENKA\n62\n0\n10\n1\n20\n2\n11\n3\n21\n2\n12\n3\n22\n4\n13\n1\n23\n4\n"
    made = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "0", 0), (4, face, 0), (5, face + "0\n3DFACE\n8\nother\n0\n3DFACE\n8\nKLEENKA\n67\n1\n", 0), (6, face.replace("ENTITIES", "BLOCKS"), 0)], "drawing_id long, content string, kind int")
    got = drawings.load_polygons(made).orderBy("drawing_id").collect()
    assert [(r.drawing_id, r.poly_id, r.color, r.load, r.points[2].x) for r in got] == [(4, 0, 0, None, 3000.0), (5, 0, 0, None, 3000.0)]
    assert drawings.load_polygons(made.limit(0)).count() == 0
    (tmp_path / "a.dxf").write_bytes(face.encode())
    assert drawings.load_polygons(drawings.read_drawings(spark, f"file://{tmp_path}/a.dxf")).count() == 1


def test_texts_are_made_once(spark):
    """Entities put no filter under what made the text, where it would make each text again."""
    made = spark.createDataFrame([(1, "0\nLINE\n8\na\n"), (2, "x"), (3, None)], "drawing_id long, content string")
    slow = made.select("drawing_id", F.regexp_replace("content", "(?s)(.*)", "$1").alias("content"))
    got = drawings.entities(slow)
    assert [(r.drawing_id, r.at, r.kind) for r in got.collect()] == [(1, 0, "LINE")]
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    assert "Filter" not in below
