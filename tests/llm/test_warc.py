import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from gridloom.llm import warc

ROWS = [(4, "http://d/", "x" * 200), (2, "http://b/", "x" * 200), (3, None, None), (1, "http://a/", "short"), (5, "http://e/", "short"), (None, "u", "x" * 200), (6, "http://f/", "é" * 300_000), (7, "http://g/\nX: y", "é" * 300_000), (4, "http://d/", "x" * 200), (8, "h", "")]


def brute():
    first = {}
    for i, _, h in ROWS:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        revisit = i is not None and h in first and i > first[h]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=repr)


def frame(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("kind", F.lit("clash")).withColumn("digest", F.lit(1))


def test_round_trip(spark):
    got = sorted(map(tuple, warc.archive(frame(spark), shards=3).collect()), key=repr)
    assert got == brute()


def test_files_are_deterministic_and_roll(spark, tmp_path):
    seen = []
    for k in range(2):
        root = f"file://{tmp_path}/{k}"
        manifest = warc.write(frame(spark), root, shards=2, roll_bytes=300).collect()
        files = sorted(f for f in os.listdir(tmp_path / str(k)) if f.endswith(".warc.gz"))
        assert len(files) == len(manifest) > 4 and not os.path.exists(tmp_path / str(k) / "tmp")
        seen.append({f: (tmp_path / str(k) / f).read_bytes() for f in files})
    assert seen[0] == seen[1]


def test_payloads_come_back(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    manifest = warc.write(frame(spark), root, shards=2)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(manifest, root, payloads=True).collect() if r["record_type"] == "response"}
    assert got[6] == ("é" * 300_000).encode() and got[3] == b"" and got[5] == b"short"


def test_damage_is_seen():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parsed(data)[0]["X-Page-ID"] == "1"
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload", b"paYload"))
    packed = gzip.compress(data, mtime=0)
    assert list(warc.members(io.BytesIO(packed * 3), 7)) == [data] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[:-4])))


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
