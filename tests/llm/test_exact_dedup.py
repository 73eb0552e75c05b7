import hashlib
import re

from pyspark.sql import functions as F

from gridloom.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (None, "a b"), (7, "é" * 50_000), (8, "é" * 50_000), (6, "x y"), (10, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("h", F.lit("clash"))
    got = sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_collision_is_split(spark):
    """Rows under one hash with other bytes are grouped by their bytes."""
    plain = spark.createDataFrame([(i, 1, 5, bytearray(s), bytearray(b"h")) for i, s in [(1, b"a"), (2, b"a"), (3, b"b"), (4, b"b"), (5, b"a")]], "doc_id long, keep_id long, group_size long, sha binary, h binary")
    odd = spark.createDataFrame([(3, bytearray(b"h"), "b"), (4, bytearray(b"h"), "b")], "doc_id long, h binary, norm string")
    plain = plain.withColumn("sha", F.when(F.col("doc_id").isin(3, 4), F.unhex(F.sha2(F.lit("b"), 256))).otherwise(F.col("sha")))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup._regrouped(plain, odd).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 5: (1, 3), 3: (3, 2), 4: (3, 2)}


def test_many_rows_without_an_id_and_with_one_id(spark):
    """Half of the rows hold one text and no id or one id: their number stays, and no step makes pairs of them."""
    n = 100_000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 4 == 1, -7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 == 3, F.concat(F.lit("t"), F.col("id") % 100)).otherwise("same text").alias("text"))
    got = exact_dedup.exact_groups(rows)
    told = got.groupBy((F.col("keep_id") == -7).alias("same")).agg(F.count("*").alias("n"), F.max("group_size").alias("size"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert sorted((r["same"], r["n"], r["size"]) for r in told) == [(False, n // 4, n // 100), (True, 3 * n // 4, 3 * n // 4)]
