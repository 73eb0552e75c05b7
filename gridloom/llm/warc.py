"""WARC: a deterministic sharded writer and its reader.

Records are sorted by page id over range partitions, in one shuffle of the payloads: the few rows that say which page is a
copy of which travel in the same shuffle and arrive just before their page. Each task writes its range to files that
roll over at a compressed size, every record its own gzip member. Headers and digests are made anew from the payload; ids
and dates depend on the record alone, so a record's bytes are the same in any run. A task writes under a temporary name
that its attempt alone uses; the list of complete files is itself a table, written by Spark's own committer, and only files
that it names are moved to their final names and read, so lost or repeated attempts leave nothing that counts.

The number of ranges follows the bytes of the payloads. Rows without an id are spread over ranges by their place.

Files are reached through pyarrow's file systems by the URI of the shared folder (file, hdfs, s3, gs and abfs; other schemes
that Spark may know, such as s3a, are refused there with an error).

Defined results. Null html: empty payload. Equal payloads of `least` bytes or more: the smallest page id is the response,
the others are revisits; smaller payloads are all responses. Null page id: written as a response, never referred to. Rows
that repeat a page id: each gets its record; one with the payload of the smallest id is a response. Null url: empty.
Empty table: no files, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import dropped, scratch_path, stored, text_of

DATE = "2000-01-01T00:00:00Z"
_BREAK = b"\r\n"
_FILE = "shard string, part int, temp string, final string, records long, bytes long, sha256 string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def referrals(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, digest and refers_to of the pages that repeat a payload."""
    signed = stored(
        pages.select("page_id", text_of("html").alias("html")).where(F.octet_length("html") >= least).where("page_id is not null").select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")),
        "warc-signed",
    )
    groups = stored(signed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-groups")
    return signed.join(groups, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(url.splitlines()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + _BREAK + block + _BREAK * 2


class _Roller:
    """Writes gzip members to files that end at the first member past roll_bytes."""

    def __init__(self, root: str, shard: int, attempt: str, roll_bytes: int):
        self.fs, self.path = _fs(root)
        self.fs.create_dir(f"{self.path}/tmp", recursive=True)
        self.shard, self.attempt, self.roll_bytes = f"{shard:06d}", attempt, roll_bytes
        self.part, self.out, self.files = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.path}/tmp/{self.shard}-{self.part:05d}-{self.attempt}"
            self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= self.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            final = f"{self.path}/shard-{self.shard}-{self.part:05d}.warc.gz"
            self.files.append((self.shard, self.part, self.temp, final, self.records, self.bytes, self.sha.hexdigest()))
            self.part, self.out = self.part + 1, None


#: About how many payload bytes a range holds.
SHARD_BYTES = 128 << 20


def shard_count(pages: DataFrame) -> int:
    """Ranges for pages (html): as many as Spark shuffles to, or more where each would hold too much."""
    total = pages.agg(F.sum(F.octet_length(text_of("html")))).first()[0] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))


def write(pages: DataFrame, root: str, shards: int | None = None, roll_bytes: int = 1 << 30, least: int = 100) -> DataFrame:
    """Writes pages (page_id, url, html) below the URI root and returns the manifest's rows, one for each file."""
    spark = pages.sparkSession
    shards = shards or shard_count(pages)
    told = referrals(pages, least).select("page_id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "refers_to", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("spread"))
    rows = pages.select("page_id", text_of("url").alias("url"), text_of("html").cast("binary").alias("html"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"), F.when(F.col("page_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0)).alias("spread"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        roller = _Roller(root, context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex}", roll_bytes)
        at, known = None, {}
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, digest, refers_to, kind = (c[i].as_py() for c in b.columns[:6])
                if page_id != at:
                    at, known = page_id, {}
                if kind == 0:
                    known[digest] = refers_to
                else:
                    roller.add(record(page_id, url, html, known.get(hashlib.sha256(html).digest()) if known else None))
        roller.roll()
        columns = list(zip(*roller.files, strict=True)) or [[]] * 7
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["shard", "part", "temp", "final", "records", "bytes", "sha256"])

    files = told.unionByName(rows).repartitionByRange(shards, "page_id", "spread").sortWithinPartitions("page_id", "kind", "html").mapInArrow(run, _FILE)
    path = f"{root}/manifest"
    files.write.parquet(path)
    manifest = spark.read.schema(files.schema).parquet(path)
    _commit(manifest, root)
    return manifest


def _commit(manifest: DataFrame, root: str) -> None:
    """Moves the manifest's files to their final names; a repeated move of the same file is no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _fs(root)
        moved = 0
        for b in batches:
            for temp, final, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                at = files.get_file_info(final)
                if at.size != size:
                    files.move(temp, final)
                moved += 1
        yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], ["moved"])

    manifest.select("temp", "final", "bytes").mapInArrow(run, "moved long").agg(F.sum("moved")).collect()
    dropped(manifest.sparkSession, f"{root}/tmp")


def members(stream: io.RawIOBase, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked, one in memory at a time."""
    left = b""
    while True:
        inflate, out, fed = zlib.decompressobj(31), [], False
        while not inflate.eof:
            data = left or stream.read(block)
            left = b""
            if not data:
                if fed:
                    raise ValueError("a gzip member is cut off")
                return
            fed = True
            out.append(inflate.decompress(data))
        left = inflate.unused_data
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises ValueError unless its lengths and digests hold."""
    head, gap, rest = data.partition(_BREAK * 2)
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    block = rest[:n]
    if not gap or not first.startswith("WARC/") or rest[n:] != _BREAK * 2 or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record's length or digest is wrong")
    return fields, block


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(manifest: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The records of the manifest's files, checked; payloads are null for revisits, and unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _fs(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                with files.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        rows.append(_row(*parsed(data), payloads))
                        held += len(rows[-1][-1] or b"") + 400
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    return manifest.select("final").repartition(max(1, manifest.count()), "final").mapInArrow(run, _RECORD)


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    number = lambda k: int(fields[k]) if fields.get(k) else None
    digest, size, payload = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(_BREAK * 2)[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload's length or digest is wrong")
    return number("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page-ID"), size, digest, payload if payloads else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def archive(pages: DataFrame, root: str | None = None, **how) -> DataFrame:
    """Writes pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    return read(write(pages, root, **how), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
