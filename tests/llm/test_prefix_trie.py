"""The trie of rebuilt conversations against one in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from gridloom.llm import prefix_trie
from gridloom.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def key(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, key(r)))] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items()), key=str)


def plain(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def check(spark, rows):
    assert plain(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def talk(rng, convs, words, longest):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in convs for t in range(rng.randrange(1, longest))]


def test_random_tries(spark):
    rng = random.Random(1)
    check(spark, talk(rng, range(-40, 300), ["a", "b"], 12) + talk(rng, range(300, 500), ["é", "", None], 4))


def test_long_and_nested(spark):
    rows = [(10 * c, t, "user", f"w{t}") for c in range(12) for t in range(40 * c + 1)]  # each a prefix of the next
    rows += [(10 * c, t, "user", f"w{t if t < 35 * c else -c}") for c in range(12, 20) for t in range(35 * c + 3)]
    check(spark, rows)


def test_copies(spark):
    check(spark, [(c, t, "user", f"w{t}") for c in range(2000) for t in range(3)] + [(c, 0, "user", f"x{c}") for c in range(2000, 2100)])


def test_packed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    check(spark, [(c, t, "user", f"w{t}") for c in range(95) for t in range(9)])


def test_edges(spark):
    rows = [(None, 0, "user", "gone"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, 5, "", ""), (5, 1, "user", "x" * 500_000), (7, 1, "user", "ab"), (8, 1, "userab", "")]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "depth", "h", "nth", "digest", "bytes", "run", "tie"):
        df = df.withColumn(name, F.lit("x"))
    assert plain(prefix_trie.trie(df)) == brute(rows)
    assert plain(prefix_trie.trie(df.where("false"))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(op13_prefix_trie(spark, sf)) == brute(rows)
