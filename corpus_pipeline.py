"""A training corpus from documents: language, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results. Null or empty text, or one without a letter: the language stage drops it. Null ids: of equal texts one row
stays, with an id if any has one; near copies without an id, or with one that other texts share, are told apart by a number
from their text and stay only where no copy with an id of its own does. Rows that repeat an id and a text are copies. Ties:
the least row as JSON. Very long texts pass whole. Empty documents: every stage gives an empty table. Extra columns, whatever
their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, language, near_dedup, packing, secrets
from gridloom.llm.common import documents, scope, stored

#: Near copies share this percentage of their five-word shingles; a pair at it goes unseen by all bands three times in a million.
PERCENT, BANDS = 80, 32


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or far from every language go."""
    return language.accepted(docs, language.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id."""
    shared = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "shared-ids")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text").join(shared, F.col("doc_id") == F.col("id"), "left")
    number = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(F.lit(1 << 62))  # larger than ids in use
    rows = rows.select("row", F.when(F.col("doc_id").isNull() | F.col("id").isNotNull(), number).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    with scope("near-copies") as result:
        gone = result(near_dedup.near_groups(rows.select("doc_id", "text"), percent=PERCENT, bands=BANDS).where("not kept").select("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows the text where it was known."""
    return secrets.redact(docs).selectExpr(*("if(n_chars is null, null, cast(char_length(text) as bigint)) as n_chars" if c == "n_chars" else c for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of each document."""
    return packing.packed(docs)


STAGES = [("language", identify), ("exact", drop_copies), ("near", drop_near_copies), ("secrets", remove_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each table between stages is deleted once the next one is written."""
    with scope("pipeline") as result:
        docs = documents(spark, sf_dir)
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        return result(STAGES[-1][1](spark, docs, sf_dir))
