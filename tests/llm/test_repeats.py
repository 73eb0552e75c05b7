import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import repeats


def brute(rows, depth):
    far = float("inf")
    first = {}
    datas = [(far if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in datas:
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            first[w] = min(i, first.get(w, far))
    out = []
    for (i, _), (n, b) in zip(rows, datas):
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < n:
                gone[p : p + depth] = [True] * depth
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(4, 40))) for _ in range(8)]
    rows = []
    for k in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(0, 5))]
        text = rnd.choice([" ", "\n", ""]).join(parts)
        rows.append((rnd.randrange(1000), text[rnd.randint(0, 10) :]))
    rows += [rows[0], (None, rows[1][1]), (None, rows[1][1]), (2000, None), (2001, ""), (2002, "ab " * 300), (2003, "ab " * 250), (2004, "z" * 49), (2005, "z" * 49), (2006, "q" * 50), (2007, "q" * 51)]
    return rows


@pytest.mark.parametrize(("seed", "common", "block"), [(1, 500, 4 << 20), (2, 2, 700), (3, 0, 2000)])
def test_against_all_windows(spark, seed, common, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("data", F.lit("clash"))
    got = sorted(map(tuple, repeats.without_repeats(df, common=common, block_bytes=block).collect()), key=repr)
    assert got == brute(rows, 50)


def test_kept_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 60 + "tail"), (2, "head" + "x" * 55)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(df, texts=True).collect()}
    assert got == {1: b"x" * 60 + b"tail", 2: b"head"}
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_radix_groups():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    for depth in (7, 8, 12, 20):
        starts = np.arange(len(data) - depth + 1)
        want = {}
        for s in starts:
            want.setdefault(data[s : s + depth].tobytes(), []).append(int(s))
        got = sorted(sorted(map(int, g)) for g in repeats.repeated_windows(data, starts, depth))
        assert got == sorted(v for v in want.values() if len(v) > 1)
