import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import quality
from gridloom.llm.common import documents, table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    got = quality.rated(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.9 and (got.predicted == got.quality).mean() > 0.9


def test_columns_agree_with_arrays(spark):
    rnd = np.random.default_rng(2)
    x = rnd.random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    model = quality.fit_arrays(x, y, ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    want = np.full(500, model.base)
    for r in model.rules:
        want += r.weight * np.logical_and.reduce([(x[:, "abc".index(s)] > t) == above for s, above, t in r.tests])
    assert np.allclose(got, 1 / (1 + np.exp(-want))) and ((got >= 0.5) == (y == 1)).mean() > 0.97


def test_lasso_meets_its_conditions():
    """At the optimum each weight's gradient is within the penalty, and at it where the weight is not 0."""
    rnd = np.random.default_rng(3)
    a, penalty = rnd.normal(size=(400, 8)), 0.03
    y = (a[:, 0] - a[:, 1] + rnd.normal(size=400) > 0).astype(float)
    b, w = quality.lasso(a, y, penalty, 3000)
    g = a.T @ (y - 1 / (1 + np.exp(-(a @ w + b)))) / 400
    assert np.all(np.abs(g) <= penalty + 1e-6) and np.allclose(g[w != 0], penalty * np.sign(w[w != 0]), atol=1e-6) and (w == 0).any()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (None, "a b"), (1, None), (4, "a\n" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("upper", F.lit(2))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 1), (None, 1, 1), (9, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.rated(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert {r["score"] for r in quality.rated(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.rated(docs.limit(0), labels).collect() == []


def plain_statistics(t):
    """The statistics of a text in plain Python."""
    n, words = max(len(t), 1), [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    share = lambda chars: sum(c in chars for c in t) / n
    return [
        math.log1p(len(t)), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#$%&*+<=>@^_`|~\\{}[]/"), share("!?"), share(".,;:"),
        n / max(len(words), 1), len(set(words)) / max(len(words), 1), float(max(map(len, words), default=0)), max(len(words), 1) / (t.count("\n") + 1),
    ]


def test_whole_query_against_plain_python(spark):
    """Statistics, labels that are held out, rules and scores, one document after the other."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc dE. !9#é\n\t" if i % 2 else "abcd efgh. ") for _ in range(rnd.randint(0, 400))) for i in range(400)] + ["", "\n", "x" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))}
    draws = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))).collect()}
    order = sorted((i for i in range(400) if not held[i]), key=lambda i: (draws[i], i))
    stats = np.array([plain_statistics(t) for t in texts])
    names = list(quality.statistics(F.col("text")))
    model = quality.fit_arrays(stats[order], np.array([1.0 - i % 2 for i in order]), names)
    assert model.rules
    got = {r["doc_id"]: r for r in quality.rated(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(stats):
        z = model.base + sum(r.weight for r in model.rules if all((x[names.index(s)] > t) == above for s, above, t in r.tests))
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-6 and got[i]["held_out"] == held[i] and got[i]["predicted"] == (got[i]["score"] >= 0.5), texts[i]


def test_first_split_against_every_split():
    rnd = np.random.default_rng(6)
    x = rnd.random((120, 4))
    y = (x[:, 2] + 0.2 * rnd.random(120) > 0.6).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(4)]
    g = y - y.mean()
    h = np.full(120, y.mean() * (1 - y.mean()))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gain, j, t = max((part(x[:, j] <= t) + part(x[:, j] > t), j, t) for j in range(4) for t in cuts[j] if 10 <= (x[:, j] <= t).sum() <= 110)
    assert quality.tree_paths(x, y, 1, 1) == [((j, False, t),), ((j, True, t),)] and gain > part(np.ones(120, bool))


def test_rules_beyond_the_bound_are_fitted_again():
    rnd = np.random.default_rng(7)
    x = rnd.random((600, 5))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (x[:, 2] > 0.9)).astype(float)
    assert len(quality.fit_arrays(x, y, list("abcde"), 5).rules) <= 5
