"""Near vectors against all pairs in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import embedding_dedup
from gridloom.llm.queries import op11_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """vec_id -> sorted (n_links, component_id, kept) by all pairs of rows."""
    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()), key=str)


def clusters(seed, groups, dims=64):
    rng, out = np.random.default_rng(seed), []
    for size in groups:
        centre = rng.normal(size=dims)
        out += [(centre / np.linalg.norm(centre) + rng.normal(size=dims) * rng.uniform(0.005, 0.03)).tolist() for _ in range(size)]
    return out


def test_links_equal_all_pairs(spark):
    vectors = clusters(1, [1] * 150 + [2] * 20 + [3, 5, 9, 40, 90])
    rows = [(k * 3 % 1009, v, k) for k, v in enumerate(vectors)]
    assert len({r[0] for r in rows}) == len(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)


def test_cells_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    rows = [(k, v, 0) for k, v in enumerate(clusters(2, [70, 30, 1, 1, 1]))]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    a, b = clusters(3, [1, 1], 5)
    rows = [(7, a, 0), (7, b, 0), (3, a, 1), (None, a, 2), (None, b, 3), (8, None, 0), (9, [], 0), (10, [0.0] * 5, 0), (11, [0.0] * 5, 0), (12, [1.0, None, 2.0], 0), (13, [1.0, float("nan")], 0), (14, [float("inf"), 1.0], 0)]
    rows += [(15, [2.0], 0), (16, [3.0], 0), (17, [-3.0], 0), (18, [1e30, 1e30], 0), (19, [1e-30, 1e-30], 0), (20, a[:4], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    extra = df.withColumn("node", F.lit("x")).withColumn("same", F.lit(1)).withColumn("rows", F.lit(2)).withColumn("vector", F.lit(3))
    assert got(extra) == brute(rows)
    assert got(df.where("false")) == []


def test_buckets_meet_at_the_threshold():
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(rng.normal(size=(20_000, 64)))
    z = rng.normal(size=x.shape)
    z = embedding_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = embedding_dedup.buckets(x), embedding_dedup.buckets(0.95 * x + np.sqrt(1 - 0.95**2) * z)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=2).any(axis=1)
    assert met.mean() > 0.9995


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in op11_embedding_dedup(spark, f"/root/testdata/{sf}").collect()), key=str) == brute(rows)
