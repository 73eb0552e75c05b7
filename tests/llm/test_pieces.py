import hashlib
import random
import zlib

from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from gridloom.llm import pieces


def as_unigram() -> SentencePieceProcessor:
    """The library's own unigram encoder with the vocabulary's pieces and scores: one enum of the file is changed."""
    with open(pieces.vocabulary(), "rb") as f:
        data = bytearray(f.read())

    def varint(i):
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return n, i

    def fields(i, end):
        while i < end:
            key, i = varint(i)
            size = 0
            if key & 7 == 2:
                size, i = varint(i)
            elif key & 7 == 5:
                size = 4
            elif key & 7 == 1:
                size = 8
            else:
                yield key >> 3, i, None
                _, i = varint(i)
                continue
            yield key >> 3, i, i + size
            i += size

    for field, i, end in list(fields(0, len(data))):
        if field == 2:
            for inner, j, _ in list(fields(i, end)):
                if inner == 3:
                    assert data[j] == 2
                    data[j] = 1
    return SentencePieceProcessor(model_proto=bytes(data))


PARTS = ["the", "tion", " ", "  ", "ß", "é", "\n", "日", "🙂", "q", "zz", "ing", "\t", "ö", "0", "́", "a", "b", "er"]


def texts(parts, n=3000):
    rnd = random.Random(11)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_against_the_librarys_unigram_lattice():
    """Single blanks and known characters only: the library adds scores as 32-bit floats, and those of the others are huge."""
    sp, encoder = as_unigram(), pieces.PieceEncoder(pieces.vocabulary(), 500)
    ts = [t for t in (" ".join(x.split()) for x in texts(["the", "tion", " ", "ing", "q", "zz", "a", "b", "er", "ö", "est", "re", "un", "m"])) if t]
    for at in range(0, len(ts), 100):
        for t, ids in zip(ts[at : at + 100], encoder.encode(ts[at : at + 100]), strict=True):
            assert ids.tolist() == sp.nbest_encode(t, nbest_size=2)[0], t


def test_round_trip():
    encoder = pieces.PieceEncoder(pieces.vocabulary(), 500)
    ts = texts(PARTS)
    for at in range(0, len(ts), 100):
        for t, ids in zip(ts[at : at + 100], encoder.encode(ts[at : at + 100]), strict=True):
            assert encoder.vocabulary.decode(ids.tolist()) == t


def test_against_every_segmentation():
    v = pieces.Vocabulary(pieces.vocabulary())

    def best(w):
        options = [(0.0, [])] if not w else []
        for n in range(1, len(w) + 1):
            if (found := v.scores.get(w[:n])) or n == 1:
                s, ids = best(w[n:])
                options.append((s + (found[0] if found else v.unknown), [found[1]] + ids if found else [v.byte_ids[b] for b in w[0].encode()] + ids))
        return max(options, key=lambda o: o[0])

    score = {i: s for s, i in v.scores.values()}
    rnd = random.Random(4)
    words = sorted({"▁" + "".join(rnd.choice("thereiong\U0001fae8") for _ in range(7)) for _ in range(200)})
    assert "\U0001fae8" not in v.scores
    for w, ids in zip(words, v.segment(words), strict=True):
        total = sum(score.get(i, 0) for i in ids) + v.unknown * w.count("\U0001fae8")
        assert abs(total - best(w)[0]) < 1e-6


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (None, "a  b "), (5, " a"), (5, " a"), (6, "a▁b"), (7, "w\n" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in pieces.round_trips(df).collect()}
    assert got[1]["n_ids"] == 0 and got[2]["round_trip"] and all(got[i]["round_trip"] for i in (3, None, 5, 7)) and not got[6]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(df)).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert pieces.round_trips(df.limit(0)).collect() == []


def test_query_rows_against_every_segmentation(spark):
    """Each row of the query, from ids of the best of all segmentations of each short word."""
    v = pieces.Vocabulary(pieces.vocabulary())

    def best(w):
        options = [(0.0, [])] if not w else []
        for n in range(1, len(w) + 1):
            if (found := v.scores.get(w[:n])) or n == 1:
                s, ids = best(w[n:])
                options.append((s + (found[0] if found else v.unknown), [found[1]] + ids if found else [v.byte_ids[b] for b in w[0].encode()] + ids))
        return max(options, key=lambda o: o[0])

    texts = ["the tree on", "a", "there\nis it", "gone there"]
    got = {r["doc_id"]: r for r in pieces.round_trips(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        back = {r["doc_id"]: r["ids"] for r in pieces.encoded(spark.createDataFrame([(i, t)], "doc_id long, text string")).collect()}[i]
        score = {k: s for s, k in v.scores.values()}
        marked = ("▁" + t.replace(" ", "▁")).split("▁")[1:]
        assert abs(sum(score.get(k, 0) for k in back) - sum(best("▁" + w)[0] for w in marked if "\n" not in w)) < 1e-6 or "\n" in t
        assert got[i]["n_ids"] == len(back) and got[i]["ids_crc32"] == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in back))
        assert got[i]["round_trip"] and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
