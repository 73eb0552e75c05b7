import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import language
from gridloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = documents(spark, SF)
    got = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").cache()
    told = got.where("lang_pred <> 'und'")
    assert told.where("lang_pred = lang").count() >= 0.95 * told.count()
    assert got.where("rejected").count() <= 0.05 * got.count()


def test_against_plain_cosine():
    """Prediction from dense vectors and an explicit loop over the centroids."""
    rnd = np.random.default_rng(1)
    idf = rnd.random(language.DIMS)
    centres = np.abs(rnd.random((5, language.DIMS))).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    model = language.Model(("a", "b"), idf, centres, np.array([0, 0, 1, 1, 1]), np.array([0.0, 2.0]))
    for text in ("abc déf", "xyz " * 3000, "éé"):
        v = np.zeros(language.DIMS)
        for p in language.places(text):
            v[p] += 1
        v = np.log1p(v) * idf
        near = [float(c @ v) / np.linalg.norm(v) for c in centres]
        lang, score, rejected = model.predict(text)
        best = int(np.argmax(near))
        assert lang == "aabbb"[best] and abs(score - near[best]) < 1e-5 and rejected == (lang == "b")


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "der hund und die katze sind nicht da", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "the dog", "en"), (7, "der die das " * 20_000, None), (1, "the cat sat on the mat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = {r["doc_id"]: r for r in language.identified(df).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[7]["lang_pred"] in ("de", "en") and language.identified(df).count() == 8
    assert language.identified(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_places(text):
    """The places of a text's n-grams, one after the other."""
    a, b, c, d = 2654435761, 2246822519, 3266489917, 668265263
    t = "".join(" " if ord(x) < 128 and not x.isalpha() else x for x in text.lower())
    t = f" {t} "
    out = []
    for n, mix, plus in ((1, (a,), 1), (2, (b, c), 2), (3, (d, a, b), 3)):
        for i in range(len(t) - n + 1):
            gram = t[i : i + n]
            if gram.strip(" "):
                h = (sum(ord(x) * m for x, m in zip(gram, mix, strict=True)) + plus) % 2**32
                h ^= h >> 15
                out.append((h * b % 2**32) >> 19)
    return out


def test_whole_query_against_plain_python(spark):
    """Frequencies, weights, clusters and predictions of a small table in plain Python."""
    rnd = random.Random(8)
    words = {"aa": "sola mira tenu paldo rivak".split(), "bb": "krox wizz übel gnarp zott".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) + rnd.choice(["", "s", ", 7"]) for _ in range(rnd.randint(4, 30))), k) for i, k in enumerate(rnd.choices(["aa", "bb"], k=60))]
    got = {r["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(p for t, _ in train for p in set(plain_places(t)))

    def vector(t):
        v = np.zeros(language.DIMS)
        for p, n in Counter(plain_places(t)).items():
            v[p] = math.log1p(n) * (math.log((1 + len(train)) / (1 + df[p])) + 0.05)
        return v / np.linalg.norm(v)

    centres = []
    for k in ("aa", "bb"):
        vs = [vector(t) for t, own in train if own == k]
        seeds = [max(range(len(vs)), key=lambda i: vs[i] @ sum(vs))]
        while len(seeds) < language.CENTROIDS:
            seeds.append(min(range(len(vs)), key=lambda i: max(vs[i] @ vs[s] for s in seeds)))
        own = [vs[s] for s in seeds]
        for _ in range(language.ROUNDS):
            of = [max(range(len(own)), key=lambda j: v @ own[j]) for v in vs]
            sums = [sum([v for v, o in zip(vs, of, strict=True) if o == j], np.zeros(language.DIMS)) for j in range(len(own))]
            own = [s / np.linalg.norm(s) if s.any() else c for s, c in zip(sums, own, strict=True)]
        centres += [(k, c) for c in own]
    for i, t, _ in rows:
        score, lang = max((float(c @ vector(t)), k) for k, c in centres)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-3 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_numerals_are_no_letters(spark):
    rows = [(1, "one two three", "en"), (2, "½ ² 12", "en"), (3, "½ a", "en")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: "en", 2: "und", 3: "en"}
