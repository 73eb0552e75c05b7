"""Merkle dataset manifest: an external-memory node store, proofs by merge-scans, and folds that show tampering.

1. Every row gives the digest of its fields. The digests, without the texts, are sorted by range into runs by language and
   id; their places are level 0 of the store, a Parquet folder with one partition a level.
2. Each level is read in the order it was written, and every eight consecutive nodes that a task sees become their parent.
   Only parents whose children lie in two file splits are put together in a shuffle: a row or two a split.
3. The trees of the languages end in subroots; these are the leaves of one more tree, built alike, whose root is the
   dataset's.
4. Proofs are read top down in bands of three levels: nodes of a band and the path of the node above it come together by
   coordinate, sorted, and one scan merges them. Paths move once for 512 nodes below them, those of leaves never: the scan
   hashes them at once and folds the leaf, or that of the tampered row, up to the root.

Defined results. Null fields are `-`. A null id sorts first, is never tampered with, and its doc_id is null; equal ids are
ordered by leaf, and equal leaves have places side by side. A null language is a tree of its own, before all others. A
language with one row has its leaf as subroot; a dataset with one language has its subroot as root. Empty texts and very long
ones are hashed whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scope, scoped_path, stored
from gridloom.llm.runs import in_order

#: Children of a node, as a power of two, and levels in a band of the scan.
BITS, BAND = 3, 3
FANOUT = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ABOVE = 99
_NODE = "tree string, n long, pos long, digest binary, doc_id long, tampered binary, name string"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """One leaf a row: its tree, digest, id, and the digest of the tampered row where the row is tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))  # "" sorts before all others
    tampered = F.when(hit, _digest(text=F.translate("text", _UPPER, _LOWER)))
    return docs.select(*FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), tampered.alias("tampered"), F.lit(None).cast("string").alias("name"))


def _joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def _risen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents of the nodes that stream by. Where a part of the children is elsewhere, digest is null and part has those here."""
    names, kinds = ["tree", "n", "pos", "digest", "first", "part"], [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    key, first, children = None, 0, []

    def closed() -> tuple:
        tree, n, parent = key
        whole = first == parent * FANOUT and len(children) == min(FANOUT, n - first)
        return tree, -(-n // FANOUT), parent, _joined(children) if whole else None, first, None if whole else b"".join(children)

    for b in batches:
        out = []
        for tree, n, pos, digest in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            now = (tree, n, pos >> BITS)
            if now != key or pos != first + len(children):
                if key:
                    out.append(closed())
                key, first, children = now, pos, []
            children.append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(closed(), kinds, strict=True)], names)


def _next_level(level: DataFrame) -> DataFrame:
    met = stored(level.where("n > 1").select("tree", "n", "pos", "digest").mapInArrow(_risen, "tree string, n long, pos long, digest binary, first long, part binary"), "merkle-met")
    parts = F.array_sort(F.collect_list(F.struct("first", "part")))  # eight at most
    merged = met.where("digest is null").groupBy("tree", "n", "pos").agg(parts.alias("parts"))
    merged = merged.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("parts", lambda p: F.lower(F.hex(p["part"]))), ""), 256)))
    whole = met.where("digest is not null").select("tree", "n", "pos", "digest").unionByName(merged.select("tree", "n", "pos", "digest"))
    return whole.selectExpr("tree", "n", "pos", "digest", "cast(null as long) as doc_id", "cast(null as binary) as tampered", "cast(null as string) as name")


def build(leaf: DataFrame, keys: list[str | Column], path: str) -> list[DataFrame]:
    """The levels of the trees over leaf rows (tree, digest, doc_id, tampered, name) in the order of keys, written to path."""
    spark = leaf.sparkSession
    leaf = stored(leaf, "merkle-leaves")
    sizes = stored(leaf.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-sizes")
    ranked = in_order(leaf, ["tree", *keys, "digest"], ["tree"], label="merkle-runs").withColumn("pos", F.col("nth") - 1)
    level = ranked.join(sizes, "tree").select("tree", "n", "pos", "digest", "doc_id", "tampered", "name").sortWithinPartitions("tree", "pos")
    most, levels = sizes.agg(F.max("n")).first()[0] or 0, []
    while True:
        levels.append(stored(level, "merkle", f"{path}/level={len(levels)}"))
        if most <= 1:
            return levels
        level, most = _next_level(levels[-1]), -(-most // FANOUT)


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree and its root's digest."""
    out = None
    for level in levels:
        one = level.where("n = 1").select("tree", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Siblings before and after, from the lowest level up."""
    at = 0
    while at < len(path):
        a = at + 2 + 32 * path[at]
        z = a + 32 * path[at + 1]
        yield path[at + 2 : a], path[a:z]
        at = z


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for before, after in _steps(path):
        digest = hashlib.sha256((before + digest + after).hex().encode()).digest()
    return digest


def _step(run: list[bytes], at: int) -> bytes:
    return bytes((at, len(run) - at - 1)) + b"".join(run[:at]) + b"".join(run[at + 1 :])


def _scanned(base: int, last: bool):
    """Merges the sorted rows of each block: the path above it, its inner levels, then the nodes of level base."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] if last else ["tree", "pos", "name", "digest", "path"]
    kinds = [pa.int64(), *[pa.string()] * 5] if last else [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def told(run: list[tuple], start: int, n: int, inner: dict, offset: dict, above: bytes) -> Iterator[tuple]:
        head, tail = above[:64], above[64:]
        up, pos, level, count = [], start >> BITS, base + 1, -(-n // FANOUT)
        while count > 1 and level < base + BAND:
            first = (pos >> BITS << BITS) - offset[level]
            up.append(_step(inner[level][first : first + FANOUT], pos & (FANOUT - 1)))
            pos, level, count = pos >> BITS, level + 1, -(-count // FANOUT)
        suffix = b"".join(up) + tail
        digests = [r[1] for r in run]
        for i, (pos, digest, doc_id, tampered, name, tree) in enumerate(run):
            path = (_step(digests, i) if n > 1 else b"") + suffix
            if not last:
                yield tree, pos, name, digest, head + path
                continue
            proof = hashlib.sha256(b"".join(a + z for a, z in _steps(path)).hex().encode()).hexdigest()
            yield doc_id, digest.hex(), head[:32].hex(), head[32:].hex(), proof, folded(tampered or digest, path).hex()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, above, inner, offset, run, group = None, b"", {}, {}, [], None
        rows: list[tuple] = []

        def flush() -> None:
            if run:
                rows.extend(told(run, group[0] << BITS, group[1], inner, offset, above))
                run.clear()

        for b in batches:
            for tree, place, level, pos, n, digest, path, doc_id, tampered, name in zip(*(b.column(k).to_pylist() for k in range(10)), strict=True):
                if (tree, place) != block:
                    flush()
                    block, above, inner, offset = (tree, place), b"", {}, {}
                if level == _ABOVE:
                    above = path
                elif level > base:
                    inner.setdefault(level, []).append(digest)
                    offset.setdefault(level, pos)
                else:
                    if (pos >> BITS, n) != group or not run:
                        flush()
                        group = (pos >> BITS, n)
                    run.append((pos, digest, doc_id, tampered, name, tree))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows.clear()
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return scan


def paths(levels: list[DataFrame], tops: DataFrame, final: bool) -> DataFrame:
    """For each leaf its path, below tops (tree, path), which has what stands above each tree; final: what its proof gives."""
    above, empty = None, "cast(null as long) as doc_id, cast(null as binary) as tampered, cast(null as string) as name"
    for base in range((len(levels) - 1) // BAND * BAND, -1, -BAND):
        low = levels[base] if base == 0 else levels[base].where("n > 1")
        ends = low.where(f"pos = 0 and n <= {FANOUT**BAND}").select("tree").join(tops, "tree").selectExpr("tree", "0L as pos", "path")
        above = ends if above is None else above.select("tree", "pos", "path").unionByName(ends)
        rows = above.selectExpr("tree", "pos as block", f"{_ABOVE} as level", "pos", "0L as n", "cast(null as binary) as digest", "path", *empty.split(", "))
        for k, level in enumerate(levels[base : base + BAND]):
            source = low if k == 0 else level
            rows = rows.unionByName(source.selectExpr("tree", f"shiftright(pos, {BITS * (BAND - k)}) as block", f"{base + k} as level", "pos", "n", "digest", "cast(null as binary) as path", "doc_id", "tampered", "name"))
        order = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")
        order = order.select("tree", "block", "level", "pos", "n", "digest", "path", "doc_id", "tampered", "name")
        if base == 0 and final:
            return order.mapInArrow(_scanned(base, True), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
        above = order.mapInArrow(_scanned(base, False), "tree string, pos long, name string, digest binary, path binary")
        above = stored(above, "merkle-paths")
    return above


def proven(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs; the node store goes to path if given."""
    spark = docs.sparkSession
    with scope("merkle-proofs") as result:
        store = path or scoped_path(spark, "merkle-store")
        trees = build(leaves(docs), [F.col("doc_id").asc_nulls_first()], f"{store}/languages")
        subroots = roots(trees)
        top = build(subroots.selectExpr("'' as tree", "digest", "cast(null as long) as doc_id", "cast(null as binary) as tampered", "tree as name"), ["name"], f"{store}/dataset")
        root = roots(top).selectExpr("tree", "concat(digest, digest) as path")  # 64 bytes of head; the second half stays the root
        heads = paths(top, root, final=False).selectExpr("name as tree", "concat(digest, substr(path, 33)) as path")
        out = paths(trees, stored(heads, "merkle-heads"), final=True)
        return result(out.withColumn("verified", F.col("folded_root") == F.col("root")))
