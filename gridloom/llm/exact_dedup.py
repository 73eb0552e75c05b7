"""Exact dedup: 128-bit content hash, smallest id kept, bytes compared inside each group.

Shuffles: one of (hash, id) pairs, counted before they move; one of the texts by their hash, to pick those of groups with
two rows or more; one of only these texts, for the comparison. Ids join nothing, so null or repeated ones cost no more than
others. A group of any size is compared with its single representative, so nothing grows with the square of a group, and
Spark may split the group over tasks, as both sides of each join come straight from an exchange: they are always merged, so
the plan, and what it moves for each row, is the same at every size of input.

Defined results. Null or empty text: one group of empty texts. Null doc_id: such a row belongs to its group and is never
the one that stays, unless all ids of the group are null, when all its rows stay. Rows that repeat an id and a text are
the same document: each is kept or dropped alike. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, stored, text_of


def normalised(col: str = "text") -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(text_of(col), SPACE, " ")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = stored(
        docs.select("doc_id", F.sha2(normalised(), 256).alias("sha")).select("doc_id", F.unhex("sha").alias("sha"), F.unhex(F.substring("sha", 1, 32)).alias("h")),
        "exact-signed",
    )
    groups = stored(signed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-groups")
    plain = (
        signed.join(groups.hint("merge"), "h", "left")
        .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "sha", "h")
    )
    odd = _collisions(docs, groups)
    if not odd.isEmpty():
        plain = _regrouped(plain, odd)
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _collisions(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose bytes differ from those of their group's representative: doc_id, h, norm."""
    hashed = docs.select("doc_id", normalised().alias("norm")).withColumn("h", F.unhex(F.substring(F.sha2("norm", 256), 1, 32)))
    texts = stored(hashed.join(groups.select("h", "keep_id").hint("merge"), "h"), "exact-texts")
    first = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.min("norm").alias("first_norm"))
    return stored(texts.join(stored(first, "exact-first"), "h").where("norm <> first_norm").select("doc_id", "h", "norm"), "exact-odd")


def _regrouped(plain: DataFrame, odd: DataFrame) -> DataFrame:
    """plain with the colliding rows taken out of their hash group and grouped by their bytes."""
    own = odd.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    moved = odd.join(own, ["h", "norm"]).select("doc_id", "keep_id", "group_size", F.unhex(F.sha2("norm", 256)).alias("sha"), "h")
    fewer = odd.groupBy("h").agg(F.count(F.lit(1)).alias("gone"))
    out = [F.col("p.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("p.sha") == F.col("m.sha")]
    rest = plain.alias("p").join(moved.alias("m"), out, "left_anti").join(fewer, "h", "left")
    return rest.select("doc_id", "keep_id", (F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"), "sha", "h").unionByName(moved)


def without_copies(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each group of equal texts: that with the smallest id. Of rows that share that id too,
    or are all without one, that which is least as JSON stays."""
    keys = ["doc_id", "text_sha256"]
    told = exact_groups(docs).groupBy(*keys).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    special = stored(told.where("not kept or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "exact-special")
    again = stored(special.where("kept"), "exact-again")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(normalised(), 256).alias("sha"))
    same = lambda t: rows["doc_id"].eqNullSafe(t["_id"]) & (rows["sha"] == t["_sha"])
    one = rows.join(again, same(again), "left_semi").groupBy("doc_id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(special.hint("merge"), same(special), "left_anti").select("row.*").unionByName(one.select("row.*"))
