import random

from test_near_dedup import shingle_set

from gridloom.llm import packing, secrets

import corpus_pipeline  # isort: skip


def rows():
    rnd = random.Random(21)
    en = "the of and to in is that it was for on are as with his they at be this from".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split()
    out = []
    for i in range(160):
        words = en if i % 3 else de
        out.append((i * 7 % 1000, " ".join(rnd.choice(words) + rnd.choice(["", "", rnd.choice(words)]) for _ in range(rnd.randint(40, 120))), "en" if i % 3 else "de"))
    for k in range(10):
        i, text, lang = out[k * 5]
        out.append((2000 + k, text + "  ", lang) if k % 2 else (3000 + k, text + " tail", lang))
    out.append((4000, out[3][1][:200] + " password = hunter2hunter2", "en"))
    out += [(5000, "12 34 !!", "en"), (5001, None, "de"), (5002, "", None), (None, out[4][1], "en")]
    out += [(None, out[7][1] + " a tail", "en"), (6000, out[11][1], "en"), (6000, out[11][1], "en"), (6000, " ".join(reversed(out[13][1].split())), "en")]
    lone = " ".join(rnd.choice(en) + rnd.choice(en) for _ in range(90))
    return [*out, (None, lone, "en"), (None, lone, None), (None, lone, None), (6001, lone[::-1], "en"), (6001, lone[::-1], "en")]


def test_against_brute_force(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in data], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        assert name == "packing" or docs.columns == df.columns
    plain = lambda rs: sorted(t for i, t in ((r["doc_id"], r["text"]) for r in rs) if i in (None, 6000, 6001))
    by_text = {i: t for i, t, _ in data}
    alone = [t for i, t, _ in data if i == 6000][1:] and sorted({t for i, t, _ in data if i == 6000} - {t for i, t, _ in data if i not in (None, 6000)})
    lone = [t for i, t, lang in data if i is None and lang is None][0]
    assert plain(seen["near"][1]) == sorted([*alone, lone, by_text[6001]])  # each text once, copies of others gone
    kept = {name: sorted((r["doc_id"], r["text"]) for r in after if r["doc_id"] is not None and r["doc_id"] < 6000) for name, (_, after) in seen.items() if name != "packing"}
    assert {i for i, _, _ in data} - {None, 6000, 6001} - {i for i, _ in kept["language"]} == {5000, 5001, 5002}
    first = {}
    for i, t in kept["language"]:
        first.setdefault(" ".join(t.split(" ")).rstrip() + (" " if t.endswith(" ") else ""), i)
    assert [i for i, _ in kept["exact"]] == sorted(first.values())
    group = {i: i for i, _ in kept["exact"]}
    sets = {i: shingle_set(t) for i, t in kept["exact"]}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = {k: min(group[i], group[j]) if g in (group[i], group[j]) else g for k, g in group.items()}
    assert [i for i, _ in kept["near"]] == sorted(i for i, g in group.items() if i == g)
    auto = secrets.automaton()
    for (i, t), (j, u) in zip(kept["near"], kept["secrets"], strict=True):
        assert i == j and (u == t if not auto.spans(t.encode()) else "hunter2" not in u and "[SECRET]" in u)
    packed = seen["packing"][1]
    encoder = packing.WordEncoder(packing.vocabulary())
    for i, t in kept["secrets"]:
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == len(encoder.ids(t.encode())) + 1
    assert {r["doc_id"] for r in packed} == {i for i, _ in kept["secrets"]} | {None, 6000, 6001}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_empty_long_and_clashing(spark, tmp_path):
    """Empty tables pass every stage; very long texts and extra columns named like the stages' own ones stay whole."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, deal long, kept boolean"
    words = "the of and to in is that it was for on are as with his they".split()
    long_text = " ".join(f"{words[i % 16]}{words[i * 7 % 13]}" for i in range(200_000))
    short = [" ".join(words[(i * k + 3) % 16] for k in range(40)) + f" note {i}" for i in range(8)]
    rows = [(i, t, "en", None, None, 1, "r", 2, True) for i, t in enumerate([long_text, *short])]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            at = f"{tmp_path}/{len(some)}-{name}"
            before = docs
            stage(spark, docs, str(tmp_path)).write.parquet(at)
            docs = spark.read.parquet(at)
            assert name == "packing" or docs.columns == before.columns
            if some and name != "packing":
                assert docs.where("doc_id = 0").first()["text"] == long_text
        assert bool(docs.count()) == bool(some)
