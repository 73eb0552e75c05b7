import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import spotsigs
from gridloom.llm.common import documents

COMMON = set(spotsigs.ANCHORS)


def chains(text):
    """Signatures in words, before they are hashed."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    gaps, anchors = [[]], ["^"]
    for w in words:
        if w in COMMON:
            anchors.append(w)
            gaps.append([])
        else:
            gaps[-1].append(w)
    out = set()
    for i, a in enumerate(anchors):
        chain = [w for g in gaps[i : i + 4] for w in g][:3]
        if chain and (i or gaps[0]):
            out.add((a, " ".join(chain)))
    for g in gaps:
        if len(g) > 12:
            out |= {("*", " ".join(g[i : i + 3])) for i in range(len(g) - 2)}
    return out or ({("raw", text)} if text.strip(" \t\n\r\x0b\x0c") else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def rows():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "of", "der", "la", "y", "is"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcö") for _ in range(rnd.randint(2, 5)))
    out = [(rnd.randrange(10_000), rnd.choice([" ", ", ", "\n"]).join(word() for _ in range(rnd.randint(0, 80)))) for _ in range(150)]
    return out + [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "!!! ..."), (20_004, "abc " * 5000), (20_005, "Of the of"), (20_006, "x"), (20_007, "x")]


@pytest.mark.parametrize("buckets", [1 << 9, 1 << 22])
def test_edited_against_plain(spark, buckets):
    data = rows()
    data = list(dict(data).items())
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ord", F.lit(1)).withColumn("bucket", F.lit("clash"))
    got = {r["doc_id"]: r for r in spotsigs.edited(df, buckets).collect()}
    data = sorted((i, t or "") for i, t in data)
    fingerprints = {}
    for k, (i, t) in enumerate(data):
        nxt = data[(k + 1) % len(data)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r["near_edited"] - alike(chains(t), chains(e))) < 1e-9, (t, e)
        assert abs(r["near_next"] - alike(chains(t), chains(nxt))) < 1e-9
        for text, f in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert len(f) == 8 * len(chains(text)) and fingerprints.setdefault(frozenset(chains(text)), f) == f
    assert len(got) == len(data)


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "the cat"), (None, "a dog"), (1, "of it all"), (1, "of it all"), (2, "in x")], "doc_id long, text string")
    assert spotsigs.edited(df).count() == 5
    one = spotsigs.edited(df.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert spotsigs.edited(df.limit(0)).collect() == []


def test_main_path_has_no_python(spark):
    plan = spotsigs.edited(documents(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_near_pairs_against_all_pairs(spark):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice(["the", "of", "and", "w1", "w2", "w3", "w4", "w5", "w6", "w7"]) for _ in range(60)) for _ in range(6)]
    data = []
    for i in range(60):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            words[rnd.randrange(60)] = f"v{rnd.randrange(50)}"
        data.append((i, " ".join(words)))
    pairs, members = spotsigs.near_pairs(spark.createDataFrame([*data, (None, "the x"), (99, "")], "doc_id long, text string"), 0.7)
    rep = dict(map(tuple, members.collect()))
    sets = {i: chains(t) for i, t in data}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(i, j) for i in set(rep.values()) for j in set(rep.values()) if i < j and alike(sets[i], sets[j]) >= 0.7}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in pairs.collect()} == want
