import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from gridloom.llm import packing

TEXTS = ["It's the CATS' 'll 'LL''s n't x'd AKIA99Z <|endoftext|> <b> &amp; a=b;c |>< ~~ !!??", "password='abc' \x7f a\x01b ''s","The cat's x y", None, "", "́a b\x1cc \x0b d<|endoftext|> e", "İΣΑΣ it's we'll 123", "word " * 5000, "z" * 30_000, "\t \n", "The cat's x y"]


def test_first_fit_against_plain():
    rnd = random.Random(3)
    for _ in range(300):
        sizes = sorted((rnd.randint(1, 50) for _ in range(rnd.randint(0, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(50)
            room[k] -= s
            want.append(k)
        assert packing.first_fit_decreasing(sizes, 50) == want


def test_words_give_the_texts_ids():
    plain = Tokenizer.from_file(packing.vocabulary())
    for remembered in (2, 300_000):
        encoder = packing.WordEncoder(packing.vocabulary(), remembered)
        for t in TEXTS:
            assert encoder.ids((t or "").encode()).tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_random_words_give_the_librarys_ids():
    rnd, plain = random.Random(5), Tokenizer.from_file(packing.vocabulary())
    encoder = packing.WordEncoder(packing.vocabulary())
    parts = ["the", "tion", "ing", "AND", "'s", "'", "99", "x", "ß", "é", "!!", ".", "www", "http://", "un", "believ", "able", "É", "<", "#"]
    words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(20_000)]
    encoder.learn([" ".join(words).encode()])
    for w, e in zip(words, plain.encode_batch(words, add_special_tokens=False), strict=True):
        assert encoder.ids(w.encode()).tolist() == e.ids, w


def test_packed(spark):
    rows = [(None if i == 3 else i % 7, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as grp")
    for group_tokens in (1 << 20, 3000):
        got = packing.packed(df, group_tokens=group_tokens, length=512).collect()
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append(r)
        for rs in by.values():
            at = 0
            for r in sorted(rs, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 512
        plain = Tokenizer.from_file(packing.vocabulary())
        want = []
        for i, t in rows:
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want += [(i, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()), len(ids)) for s in range(0, len(ids), 512)]
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert packing.packed(df.limit(0)).collect() == []


def test_packing_follows_no_file(spark):
    """Very long documents and rows repeated very often are dealt by pieces, alike from one file and from many."""
    rows = [(1, "word " * 9000), (2, "other words " * 4000)] + [(3, "again and again")] * 5000 + [(None, "no id")] * 3000 + [(k, f"document {k} " * (k % 40)) for k in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(str, packing.packed(df.repartition(n), length=256, group_tokens=4000).collect())) for n in (1, 7))
    assert one == many and len({r for r in one}) > 400


def test_a_word_is_numbered_when_it_is_first_met():
    encoder = packing.WordEncoder(packing.vocabulary(), 3)
    assert [n.tolist() for n in encoder.numbers([b"one two  one", b"", b"three two"])] == [[0, 1, 0], [], [2, 1]]
    assert [n.tolist() for n in encoder.numbers([b"three four"])] == [[2, 3]]
    assert [n.tolist() for n in encoder.numbers([b"four"])] == [[0]] and len(encoder.place) == 1  # more than it remembers: it starts anew
