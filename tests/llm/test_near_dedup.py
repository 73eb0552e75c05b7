import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import near_dedup
from gridloom.llm.components import components
from gridloom.llm.shingles import Shingler, super_minhash


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(shingle_set(t)), None if i is None else find(i), i is not None and find(i) == i) for i, t in rows if i is not None)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 12, 60, 150]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows) * 3 % 401, " ".join(copy) + rnd.choice(["", " ", "\n"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b C"), (1004, "a B c"), (1005, "x " * 30_000)]
    df = spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(2))
    got = [tuple(r)[:4] for r in near_dedup.near_groups(df).collect()]
    assert (None, 1, None, False) in got
    assert sorted(r for r in got if r[0] is not None) == brute(rows)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h")], "doc_id long, text string")
    assert near_dedup.near_groups(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in near_dedup.near_groups(df).collect()) == [(1, 2, 1, True), (2, 1, 2, True)]


def test_components_of_chains(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000 + i) for i in range(200)] + [(5, 5)]
    rnd.shuffle(edges)
    df = spark.createDataFrame([(b, a) if rnd.random() < 0.5 else (a, b) for a, b in edges], "a long, b long").repartition(7)
    got = dict(map(tuple, components(df).collect()))
    assert got == {i: 0 for i in range(1, 301)} | {2000 + i: 1000 for i in range(200)}


def plain_super_minhash(elements, m):
    """One element at a time, with the same draws."""
    from gridloom.llm.shingles import _C, mixed

    best = [float("inf")] * m
    for e in elements:
        order = list(range(m))
        for j in range(m):
            with np.errstate(over="ignore"):
                x = int(mixed(np.array([e + np.uint64(j + 1) * _C], np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], j << 32 | x >> 32)
    return best


def test_signature_against_plain_and_its_spread():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        e = rnd.integers(0, 2**63, n, dtype=np.uint64)
        assert super_minhash(e, 24).tolist() == plain_super_minhash(e, 24)
    got = []
    for _ in range(200):
        u = rnd.integers(0, 2**63, 60, dtype=np.uint64)
        got.append((super_minhash(u[:50], 100) == super_minhash(u[10:], 100)).mean())
    assert abs(np.mean(got) - 40 / 60) < 0.01 and np.std(got) < (2 / 9 / 100) ** 0.5


def test_shingles_of_few_words():
    s = Shingler()
    assert len(s.hashes(b"")) == 0 and len(s.hashes(b"a b")) == 1 and len(s.hashes(b"a b c d e a b c d e")) == 5
    assert s.hashes("Ä b c".encode()).tolist() != s.hashes("ä b c".encode()).tolist()
