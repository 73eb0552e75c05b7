"""Roots, proofs and folds against a plain tree over sorted rows."""

import hashlib
import random
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from gridloom.llm import merkle
from gridloom.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree(leaves):
    """The root, and for each leaf its path: for each level the siblings before and after."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, at in enumerate(place):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append((run[: at % 8], run[at % 8 + 1 :]))
        level = [h(*level[a : a + 8]) for a in range(0, len(level), 8)]
        place = [p // 8 for p in place]
    return level[0], paths


def brute(rows):
    trees, out = [], []
    for lang, some in groupby(sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode())), key=lambda r: r[2]):
        some = sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        leaves = [leaf(r, r[1]) for r in some]
        trees.append((lang, some, leaves, *tree(leaves)))
    root, tops = tree([t[3] for t in trees]) if trees else (None, [])
    for (_, some, leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for r, own, path in zip(some, leaves, paths, strict=True):
            path, now = path + top, own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf(r, r[1].translate(UPPER))
            for a, z in path:
                now = h(*a, now, *z)
            out.append((r[0], own, subroot, root, h(*(x for a, z in path for x in a + z)), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.proven(df).collect()), key=str)


def made(n, langs, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcXYZé ß") for _ in range(rng.randrange(9)))
    return [(k, rng.choice([None, "", word(), word().upper()]), rng.choice(langs), rng.choice([None, "s", "tü"]), rng.choice([None, k])) for k in rng.sample(range(10 * n), n)]


def test_trees_of_many_heights(spark):
    rows = [r for k, n in enumerate((1, 2, 8, 9, 64, 65, 511, 513, 600, 1100)) for r in made(n, [f"l{k}"], k)] + made(30, [None])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_many_languages(spark):
    rows = made(900, [None, "", "é", *(f"x{k}" for k in range(700))])
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_language_and_one_row(spark):
    rows = made(700, ["en"])
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame(rows[:1], SCHEMA)) == brute(rows[:1])


def test_nulls_ties_and_extra_columns(spark):
    rows = made(40, ["a", None]) + [(None, "T", "a", None, None)] * 3 + [(None, None, None, None, None)] * 2 + [(5, "Aa", "a", "s", 1), (5, "Aa", "a", "s", 1), (5, "Bb", "a", "s", 1), (6, "Long É " * 200_000, "a", "s", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    for name in ("tree", "n", "pos", "digest", "level", "run", "nth", "tie"):
        df = df.withColumn(name, F.lit("x"))
    assert got(df) == brute(rows)
    assert got(df.where("false")) == []


def test_store_has_every_level(spark, tmp_path):
    rows = made(600, ["a", "b"])
    merkle.proven(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/store").collect()
    store = spark.read.parquet(f"file://{tmp_path}/store/languages")
    for lang in ("a", "b"):
        n, counts = sum(r[2] == lang for r in rows), []
        while not counts or counts[-1] > 1:
            counts.append(n)
            n = -(-n // 8)
        assert [r["count"] for r in store.where(F.col("tree") == f"={lang}").groupBy("level").count().orderBy("level").collect()] == counts


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op12_merkle_manifest(spark, sf).collect()), key=str) == brute(rows)
