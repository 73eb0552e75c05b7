"""One query for each operator over its whole table, and SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import embedding_dedup, exact_dedup, language, merkle, near_dedup, oracles, packing, pieces, prefix_trie, quality, repeats, secrets, spotsigs, warc
from gridloom.llm.common import documents, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_exact_dedup, op3_spotsigs, op4_suffix_dedup, op5_secret_scan, op6_language_id, op7_sentencepiece, op8_packing, op9_warc, op10_quality, op11_embedding_dedup, op12_merkle_manifest, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": oracles.NEAR, "op2_exact_dedup": oracles.EXACT, "op5_secret_scan": oracles.SECRETS, "op9_warc": oracles.WARC, "op11_embedding_dedup": oracles.EMBEDDINGS, "op12_merkle_manifest": oracles.MERKLE, "op13_prefix_trie": oracles.TRIE}
