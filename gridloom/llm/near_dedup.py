"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Every text gives the hashes of its distinct shingles, from them the signature and one key a band, and a 128-bit hash
   of the set. Documents of one set are a class, represented by its smallest id; only representatives go on, so exact
   copies cost nothing more. With the default of 24 bands of 5 a pair at the threshold shares no key once in a million.
2. Keys that two representatives or more share are buckets. For members of buckets the sets are made again and written;
   the shingles that no other member has are counted, and members with too many of them can have no link and go.
3. In each bucket the member with the smallest share of such shingles is the centre, and each other member is compared
   with it. What is linked is grouped.
4. Where members of a centre are still in different groups, they are compared by what they differ in from the centre: only pairs
   that share a rare difference, and enough of them, can be linked, and these are verified on full sets. So no pair that
   shares a key stays undecided, while a group of copies never gives all its pairs.

Defined results. No words, empty or null text: no shingles, linked with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Null id: n_shingles is given, component_id is null, kept is false. Rows that repeat an id
repeat its text; they share their results. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, stored, text_of
from gridloom.llm.components import components
from gridloom.llm.shingles import WORDS, Shingler, band_keys, mixed, super_minhash

BANDS, ROWS = 24, 5
_SALTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))


def _set_hash(hashes: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return b"".join(mixed(hashes ^ s).sum(dtype=np.uint64).tobytes() for s in _SALTS)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_hash and keys, one for each band."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sizes, hashes, keys = [], [], []
            for text in b.column(1):
                s = shingler.hashes(text.as_py())
                sizes.append(len(s))
                hashes.append(_set_hash(s) if len(s) else None)
                keys.append(band_keys(super_minhash(s, bands * rows), bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "keys"])

    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, keys array<long>")


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and shingles, the hashes of the distinct ones, in order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sets = pa.array([shingler.hashes(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["doc_id", "shingles"])

    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


def _linked(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of n and m elements that differ in `apart` elements are similar enough."""
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    first = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("bs")), "b")
    both = first.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("as")), "a")
    common = F.size(F.array_intersect("as", "bs")).cast("long")
    return both.where(_linked(F.size("as"), F.size("bs"), F.size("as") + F.size("bs") - 2 * common, percent)).select("a", "b")


def _centred(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each member with each centre of a bucket of it: a (the centre), b, n, delta (what one has and the other has not), linked."""
    centre = members.groupBy("key").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "doc_id")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = members.join(stored(centre.select("key", F.col("c.doc_id").alias("a")), "near-centres"), "key").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    first = stored(met, "near-met").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("bs")), "b")
    both = first.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("as")), "a")
    delta = F.concat(F.array_except("as", "bs"), F.array_except("bs", "as"))
    rows = both.select("a", "b", F.size("bs").cast("long").alias("n"), F.size("as").alias("m"), delta.alias("delta"))
    return rows.withColumn("linked", _linked(F.col("n"), F.col("m"), F.size("delta"), percent)).drop("m")


def _open_pairs(centred: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of members of one centre, in different parts, that may be similar enough.

    What x and y differ in is the symmetric difference of their deltas. With k = (100 - percent) / (100 + percent) a link
    means that it has k(|x| + |y|) elements at most. If x is not linked with the centre, its delta has more than
    k(|x| + |centre|); then more than (1 - k) / 2 of y's delta must be common to both deltas. So of the rarest elements of
    y's delta, all but that share of it, one is in x's; and if y is not linked either, the same holds for x's. Elements
    that no member of another part has in its delta cannot be common, which rules out most pairs by number alone."""
    k = (100 - percent) / (100 + percent)
    spread = centred.select("a", "b", "part", "linked", F.explode("delta").alias("e"))
    counts = spread.groupBy("a", "e").agg(F.count(F.lit(1)).alias("f"), F.count_if("linked").alias("fl"), F.min("part").alias("low"), F.max("part").alias("high"))
    counts = stored(counts.where("low <> high").select("a", "e", "f", "fl"), "near-counts")
    ranked = spread.drop("part", "linked").join(counts, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("f", "e", "fl"))).alias("common"))
    rows = centred.select("a", "b", "n", "part", "linked", F.size("delta").alias("d")).join(ranked, ["a", "b"]).withColumn("t", F.size("common"))
    rows = rows.where(F.col("d") - F.col("t") <= k * (1 + 100 / percent) * F.col("n"))
    lead = F.greatest(F.lit(0), F.col("t") - F.floor((1 - k) / 2 * F.col("d")).cast("int"))
    rows = stored(rows.select("a", F.struct("b", "n", "part", "d", "t").alias("x"), "linked", "common", F.slice("common", F.lit(1), lead).alias("rare")), "near-ranked")
    side = lambda test, which, name: rows.where(test).select("a", F.col("x").alias(name), F.explode(which).alias("c")).select("a", name, "c.e")
    most = F.least("x.t", "y.t")
    fits = (F.col("x.part") != F.col("y.part")) & _linked(F.col("x.n"), F.col("y.n"), F.col("x.d") + F.col("y.d") - 2 * most, percent)
    apart = side("not linked", "rare", "x").join(side("not linked", "rare", "y"), ["a", "e"]).where((F.col("x.b") < F.col("y.b")) & fits)
    told = side("not linked", F.filter("common", lambda c: c["fl"] > 0), "x"), side("linked", F.filter("rare", lambda c: c["f"] > c["fl"]), "y")
    mixed_pairs = told[0].join(told[1], ["a", "e"]).where(fits)
    return apart.unionByName(mixed_pairs).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def links(reps: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = 85) -> DataFrame:
    """Links (a, b) that connect what the verified pairs of reps (doc_id, keys) connect; docs has their texts."""
    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-shared")
    members = stored(keyed.join(shared, "key"), "near-members")
    ids = stored(members.select("doc_id").distinct(), "near-ids")
    sets = stored(shingled(docs.join(ids, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "near-sets")
    once = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    alone = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    facts = sets.select("doc_id", F.size("shingles").cast("long").alias("n")).join(alone, "doc_id", "left").select("doc_id", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    members = stored(members.join(stored(facts.where(f"100 * (n - alone) >= {percent} * n"), "near-facts"), "doc_id"), "near-linkable")
    centred = stored(_centred(members, sets, percent), "near-centred")
    near = centred.where("linked").select("a", "b")
    groups = stored(components(near).select(F.col("node").alias("b"), F.col("root").alias("part")), "near-groups")
    placed = stored(centred.join(groups, "b", "left").withColumn("part", F.coalesce("part", "b")), "near-placed")
    unsure = stored(placed.groupBy("a").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("a"), "near-unsure")
    late = _verified(stored(_open_pairs(placed.join(unsure, "a"), percent), "near-open"), sets, percent)
    return near.unionByName(stored(late, "near-late"))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text): links at percent similarity or more."""
    docs = docs.select("doc_id", "text")
    told = stored(signed(docs, words, bands, rows), "near-signed")
    classes = stored(told.where("doc_id is not null and set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "near-classes")
    placed = told.join(classes, "set_hash", "left").select("doc_id", "n_shingles", "keys", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    placed = stored(placed.withColumn("keys", F.when(F.col("doc_id") == F.col("rep"), F.col("keys"))), "near-reps")
    reps = placed.where("keys is not null").select("doc_id", "keys").dropDuplicates(["doc_id"])
    roots = stored(components(links(reps, docs, words, percent)), "near-roots")
    out = placed.drop("keys").join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
