"""Document fingerprints by SpotSigs, in Spark's own expressions only.

Words are runs of letters and digits, lower-cased. Each common word is an anchor; its signature is the anchor with the chain
of the next `CHAIN` words that are not common, looked for in the gap after the anchor and the three gaps that follow. The
start of a text that does not begin with an anchor counts as one. In a gap of more than `GAP` words, where no anchor tells
anything, every word is the anchor of the two behind it. The distinct signatures, 32 bits each, are the set of a
document, and in order, as hexadecimal digits, its fingerprint.

Sets are compared by Jaccard similarity. `near_pairs` partitions sets by length, so that only sets whose lengths can reach
the threshold meet, and joins them on their rarest signatures; equal sets are one class.

`edited` compares documents with their successor without a window over the whole table: ids are cut at quantiles, and
between them by value, into buckets of a bounded size whose number follows the input; each bucket also gets the first
document of the next one, told by a table of one row a bucket. Many rows of one id, or without one, are dealt by text.

Defined results. Null or empty text, or white space alone: the empty fingerprint; two empty sets are alike (1.0). A text of
marks alone has one signature, its own hash. Null ids sort first; rows that repeat an id are ordered by the text's hash; a
lone document is its own successor. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored, text_of

CHAIN, GAP = 3, 12
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "auch auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux dans de des du elle en est et il la le les ne pas pour qui sur un une "
    "con del el es las lo los no para por que se su una y"
).split()
_ANCHOR_GAP = f" (?=(?:{'|'.join(sorted(set(ANCHORS)))}) )"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _signature(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(0x7FFFFFFF).cast("int")


def _long_gap(content: Column) -> Column:
    """Signatures of each word of a gap that is too long, none for others."""
    chains = lambda w: F.when(F.size(w) > GAP, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: _signature(F.lit("*"), F.concat_ws(" ", F.slice(w, i, 3))))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(F.length(content) <= 2 * GAP, F.expr("cast(array() as array<int>)")).otherwise(let(F.split(content, " "), chains))


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    parts = F.split(F.concat(F.lit(" "), words, F.lit(" ")), _ANCHOR_GAP)
    content = lambda p, i: F.trim(F.when(i == 0, p).otherwise(F.substr(p, F.instr(F.concat(p, F.lit(" ")), " ") + 1)))

    def chained(p: Column, i: Column, gaps: Column) -> Column:
        chain = F.substring_index(F.concat_ws(" ", F.filter(F.slice(gaps, i + 1, 4), lambda g: g != "")), " ", CHAIN)
        anchor = F.when(i == 0, F.lit("^")).otherwise(F.substring_index(p, " ", 1))
        return F.when((chain != "") & ((i > 0) | (gaps[0] != "")), _signature(anchor, chain))

    spots = lambda ps: let(F.transform(ps, content), lambda gaps: F.concat(F.transform(ps, lambda p, i: chained(p, i, gaps)), F.flatten(F.transform(gaps, _long_gap))))
    own = F.array_sort(F.array_distinct(F.filter(let(parts, spots), lambda s: s.isNotNull())))
    alone = F.when(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) == "", F.expr("cast(array() as array<int>)")).otherwise(F.array(_signature(F.lit("raw"), text)))
    return let(own, lambda s: F.when(F.size(s) > 0, s).otherwise(alone))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    share = lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n).cast("double"))
    return let(F.size(F.array_intersect(a, b)).cast("double"), share)


_LOW = -(1 << 63)
#: Quantiles of doc_id that one pass finds; larger inputs divide each of their ranges further, by the ids themselves.
_RANGES = 1 << 12


def _count(cuts: Column, n: int, below: Callable[[Column], Column]) -> Column:
    """How many of n sorted cuts are below, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & below(F.get(cuts, at + s - 1)), at + s).otherwise(at))


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (id, ord) with bucket, which grows with id and then ord. Ids between two quantiles share out that range's buckets
    by their value; an id that fills whole ranges shares them out by ord."""
    ranges = max(1, min(buckets, _RANGES))
    shares = ", ".join(str(i / ranges) for i in range(ranges + 1))
    cuts = rows.agg(F.expr(f"percentile_approx(id, array({shares}), 100000)")).first()[0] if ranges > 1 else None
    if not cuts:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    n, sub = len(cuts), -(-buckets // ranges)
    listed = F.from_json(F.lit("[" + ",".join(map(str, sorted(cuts))) + "]"), "array<bigint>")
    lo, hi = _count(listed, n, lambda c: c < F.col("id")), _count(listed, n, lambda c: c <= F.col("id"))
    rows = rows.withColumn("lo", lo).withColumn("hi", hi)
    low, high = (F.get(listed, F.col("lo") + i).cast("double") for i in (-1, 0))
    share = F.when((F.col("lo") > 0) & (F.col("lo") < n), F.greatest(F.lit(0.0), F.least((F.col("id") - low) / (high - low), F.lit(1 - 2**-20)))).otherwise(0.0)
    alike = (F.col("ord").cast("double") + 2.0**63) / 2.0**64 * (F.col("hi") - F.col("lo") - 1)
    at = F.when(F.col("hi") > F.col("lo"), F.col("lo") + 1 + F.least(alike, F.col("hi") - F.col("lo") - 1)).otherwise(F.col("lo") + share)
    return rows.withColumn("bucket", F.floor(at * sub).cast("long")).drop("lo", "hi")


def _homes(placed: DataFrame) -> DataFrame:
    """The first (id, ord) of each bucket and the bucket before it, for the first one the last: one row a bucket."""
    firsts = stored(placed.groupBy("bucket").agg(F.min(F.struct("id", "ord")).alias("first")).withColumn("block", F.shiftright("bucket", 12)), "spot-firsts")
    blocks = firsts.groupBy("block").agg(F.max("bucket").alias("last"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("block")), F.max("last").over(Window.partitionBy(F.lit(0))))
    blocks = blocks.select("block", before.alias("before"))
    home = F.coalesce(F.lag("bucket").over(Window.partitionBy("block").orderBy("bucket")), F.col("before"))
    return stored(firsts.join(blocks, "block").select("bucket", "first.id", "first.ord", home.alias("home")), "spot-homes")


def with_successor(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """rows (doc_id, ord and columns) with next_ of each column: that of the next row by doc_id, ord; of the first after the last."""
    placed = _placed(rows.withColumn("id", F.coalesce("doc_id", F.lit(_LOW))), buckets)
    homes = _homes(placed.select("id", "ord", "bucket"))
    guest = lambda at, is_guest: F.struct(at.alias("bucket"), F.lit(is_guest).alias("guest"))
    own = guest(F.col("bucket"), False)
    dealt = placed.join(homes, ["bucket", "id", "ord"], "left").withColumn("place", F.explode(F.when(F.col("home").isNull(), F.array(own)).otherwise(F.array(own, guest(F.col("home"), True)))))
    dealt = dealt.drop("bucket", "home").select("*", "place.bucket", "place.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "id", "ord")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("not guest").drop("place", "bucket", "guest", "id")


def edited(docs: DataFrame, bucket_chars: int = 1 << 22) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text ends in the successor's first characters."""
    total = docs.agg(F.sum(F.char_length(text_of()))).first()[0] or 0
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), round(total / bucket_chars))
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("ord"), signatures(F.col("text")).alias("sigs"))
    rows = with_successor(rows, ["text", "sigs"], buckets)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = rows.select("*", signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of class representatives whose sets reach the threshold, and members (doc_id, rep) of classes.

    A class is all documents of one fingerprint, its representative the smallest id; empty sets are in no class."""
    rows = docs.where("doc_id is not null").select("doc_id", signatures(text_of()).alias("sigs")).where("size(sigs) > 0").withColumn("fp", F.sha2(F.array_join("sigs", ","), 256))
    rows = stored(rows, "spot-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "spot-classes")
    members = rows.join(classes, "fp").select("doc_id", "rep")
    reps = stored(rows.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "sigs"), "spot-reps")
    spread = reps.select("doc_id", F.explode("sigs").alias("s"))
    counts = stored(spread.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "spot-counts")
    ranked = spread.join(counts, "s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("common"))
    size = F.size("sigs")
    lead = size - F.ceil(F.lit(threshold) * size).cast("int") + 1  # of the rarest signatures one at least is shared
    alone = size - F.size("common")
    step = 1 / math.log(1 / threshold)
    prefix = reps.join(ranked, "doc_id").select("doc_id", size.alias("n"), F.floor(F.log(size.cast("double")) * step).cast("int").alias("part"), F.explode(F.slice("common", F.lit(1), F.greatest(lead - alone, F.lit(0)))).alias("c")).select("doc_id", "n", "part", "c.s")
    prefix = stored(prefix, "spot-prefix")
    x = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "s")
    y = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), "part", "s")
    met = x.join(y, ["part", "s"]).where((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))).where(F.col("an") >= threshold * F.col("bn")).select("a", "b").distinct()
    both = stored(met, "spot-met").join(reps.select(F.col("doc_id").alias("a"), F.col("sigs").alias("x")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("sigs").alias("y")), "b")
    pairs = both.select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold)
    return pairs, members
