"""Conversation prefix trie by preorder intervals: ranks of distinct nodes, subtree ends, and differences of prefix sums.

1. Turns become 128-bit digests of role and text; from here on texts do not move. Each conversation is put in order and
   rebuilt; a node is named by the running total of the mixed digests of its turns, so neither a long conversation nor a
   deep trie needs one task or one step a level.
2. Nodes are counted, and each node's heavy child is the one with most members. A path from the root leaves heavy children
   for light ones log2(conversations) times at most, and these places, in order, are the node's rank key: sorting by it
   puts every subtree into one interval that begins with its top.
3. Nodes are sorted by range. Nodes of one heavy path end their subtrees with the path's last node, so the end of a subtree
   and the totals there are those of one row a path, and leaves and savings are differences of two running totals.
4. Ids that end at a node are sorted, packed a run at a time, and hashed as they stream by.

Defined results. A null conv_id is no conversation; its rows are ignored. Null role or text is empty. A null turn comes
first; turns with one number, repeated rows among them, are kept and ordered by the digest of role and text. An empty table
gives no rows. Empty and very long texts are hashed whole. Extra columns are ignored. The digest of a node that very many
identical conversations end at is taken by one task, over ids packed into a byte or two each: a SHA-256 has no other order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import scope, stored, text_of
from gridloom.llm.runs import in_order
from gridloom.llm.shingles import mixed

#: A conversation takes up to so many turns of another, less one, and conversations of so many numbers share one.
HEADS, SHARED = 9, 5
#: Bits of each of the three parts of a node's name; ids in a packed chunk.
LANE, CHUNK = 42, 1 << 14
_MASK = (1 << LANE) - 1
_LANES = ("l0", "l1", "l2")
_NONE = hashlib.sha256(b"").hexdigest()


def turns(talk: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, and the text's UTF-8 bytes."""
    said = talk.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of().alias("text"))
    whole = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return said.select("conv_id", "turn", F.substring(whole, 1, 32).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(talk: DataFrame) -> DataFrame:
    """conv_id, depth, digest and bytes of each turn of each rebuilt conversation, and a row of depth 0 for each."""
    own = in_order(stored(turns(talk), "trie-turns"), ["conv_id", "turn", "digest"], ["conv_id"], label="trie-own")
    own = stored(own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")), "trie-numbered")
    convs = stored(own.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base")).distinct(), "trie-convs")
    heads = own.where(f"conv_id % {SHARED} = 0 and nth < {HEADS}").select(F.col("conv_id").alias("of"), F.col("nth").alias("at"), "digest", "bytes")
    taken = convs.join(heads, (F.col("of") == F.col("base")) & (F.col("at") <= F.col("h"))).selectExpr("conv_id", "1 as part", "at", "digest", "bytes")
    kept = own.where("nth > h").selectExpr("conv_id", "2 as part", "nth as at", "digest", "bytes")
    tops = convs.selectExpr("conv_id", "0 as part", "0L as at", "'' as digest", "0L as bytes")
    rows = in_order(stored(taken.unionByName(kept).unionByName(tops), "trie-rebuilt"), ["conv_id", "part", "at"], ["conv_id"], label="trie-ordered")
    return rows.select("conv_id", (F.col("nth") - 1).alias("depth"), "digest", "bytes")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the three parts of what a turn adds to its node's name: its digest and depth, mixed; nothing for the root."""
    with np.errstate(over="ignore"):
        for b in batches:
            depth = b.column(1).to_numpy().astype(np.uint64)
            half = np.frombuffer(bytes.fromhex("".join(d or "0" * 32 for d in b.column(2).to_pylist())), np.uint64).reshape(-1, 2)
            a, z = mixed(half[:, 0] ^ mixed(depth + np.uint64(1))), mixed(half[:, 1] ^ mixed(depth + np.uint64(1 << 40)))
            parts = (a & np.uint64(_MASK), z & np.uint64(_MASK), (a >> np.uint64(LANE)) | ((z >> np.uint64(LANE)) << np.uint64(64 - LANE)))  # 42, 42 and 44 bits
            lanes = [np.where(depth == 0, 0, (p & np.uint64(_MASK)).astype(np.int64)) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *map(pa.array, lanes)], ["conv_id", "depth", "bytes", *_LANES])


def members(talk: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent and bytes for each node that a rebuilt conversation passes."""
    rows = stored(rebuilt(talk).mapInArrow(_named, "conv_id long, depth long, bytes long, l0 long, l1 long, l2 long"), "trie-named")
    rows = in_order(rows, ["conv_id", "depth"], ["conv_id"], _LANES, LANE, "trie-names")
    node = [F.col(f"all_{x}") for x in _LANES]
    before = [(F.col(f"all_{x}") - F.col(x)).bitwiseAND(_MASK) for x in _LANES]
    hexed = lambda parts: F.concat(*(F.lpad(F.hex(p), 11, "0") for p in parts))
    return stored(rows.select("conv_id", "depth", hexed(node).alias("node"), F.when(F.col("depth") > 0, hexed(before)).alias("parent"), "bytes"), "trie-members")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows of a run as chunks: node, the first id, and the ids' decimals, comma-joined and compressed."""
    node, ids = None, []

    def chunk() -> tuple:
        return node, ids[0], len(ids), zlib.compress(",".join(map(str, ids)).encode(), 1)

    for b in batches:
        out = []
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != node or len(ids) == CHUNK:
                if ids:
                    out.append(chunk())
                node, ids = n, []
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["node", "first", "n", "packed"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in chunk()], ["node", "first", "n", "packed"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's chunks, which come sorted."""
    node, digest = None, hashlib.sha256()
    for b in batches:
        out = []
        for n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(zlib.decompress(packed))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """node and ends_sha256 for each node that a conversation ends at."""
    last = stored(rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")).select("node", "conv_id"), "trie-ends")
    packed = stored(last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_packed, "node string, first long, n long, packed binary"), "trie-packed")
    dealt = packed.repartition("node").sortWithinPartitions("node", "first").select("node", "packed")
    return dealt.mapInArrow(_hashed, "node string, ends_sha256 string")


def _ranked(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes with key, by which they sort in preorder, and path, the top of the heavy path that the node is on."""
    light = stored(nodes.where("light").select(F.col("node").alias("light_node")), "trie-light")
    turned = rows.join(light, F.col("node") == F.col("light_node")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("turned"))  # log2(conversations) at most
    out = nodes.join(stored(turned, "trie-turned"), "conv_id", "left").withColumn("turned", F.filter("turned", lambda t: t["depth"] <= F.col("depth")))
    number = lambda d: F.lpad(F.hex(d), 12, "0")
    led = F.transform("turned", lambda t: F.concat(number(t["depth"] - 1), t["node"]))
    key = F.concat(F.coalesce(F.array_join(led, ""), F.lit("")), number(F.col("depth")))
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "bytes", key.alias("key"), F.coalesce(F.try_element_at("turned", F.lit(-1))["node"], F.lit("")).alias("path"))


def trie(talk: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations of talk (conv_id, turn, role, text), as the module says."""
    with scope("prefix-trie") as result:
        rows = members(talk)
        nodes = stored(rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
        inner = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "node"))["node"].alias("heavy"))
        tops = nodes.join(inner.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        tops = stored(tops, "trie-tops")
        up = stored(tops.where("heavy is not null").select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"), "heavy"), "trie-up")
        placed = tops.drop("heavy").join(up, F.col("parent") == F.col("of"), "left")
        placed = placed.select("node", "conv_id", "depth", "parent_conv_id", "bytes", "n_convs", "n_children", F.coalesce(F.col("node") != F.col("heavy"), F.lit(False)).alias("light"))
        ranked = _ranked(stored(placed, "trie-placed"), rows)
        summed = ranked.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("all_one", F.lit(""))
        order = stored(in_order(stored(summed, "trie-ranked"), ["all_one", "key"], ["all_one"], ("leaf", "saved"), label="trie-preorder"), "trie-totals")
        last = order.groupBy("path").agg(F.max(F.struct("nth", "all_leaf", "all_saved")).alias("end")).withColumnRenamed("path", "top")
        told = order.join(stored(last, "trie-last"), F.col("path") == F.col("top"))
        told = told.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end.all_leaf") - F.col("all_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end.all_saved") - F.col("all_saved") + F.col("saved")).alias("saved_tokens"))
        told = stored(told, "trie-told").join(stored(ends(rows), "trie-hashes"), "node", "left")
        return result(told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")))
