"""The queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import (
    exact_dedup,
    language,
    lexical_search,
    lm_scoring,
    merkle,
    mixing,
    oracles,
    packing,
    pii,
    quality,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_rows,
)
from turnledger.llm.common import documents, fold_ascii, text_of, word_count


def pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_count(text_of("text")))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is the documents labelled as good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lm_scoring.score(documents(spark, sf_dir), labels.filter("quality = 1"))


def line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("text_key", "lost_lines")


def gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).drop("text_key")


def best_fit_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows.token_rows(documents(spark, sf_dir))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(documents(spark, sf_dir), items)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against the root; a fifth of the identifiers has its text tampered with."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = {"text": F.when(F.col("text").isNotNull(), fold_ascii(F.col("text")))}
    return merkle.verify(merkle.leaves(documents(spark, sf_dir), changed=lowered, when=tampered))


def ngram_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_sanitisation": pii_sanitisation,
    "op2_tree_merge_dedup": tree_merge_dedup,
    "op3_length_bucket_packing": length_bucket_packing,
    "op4_suffix_array_dedup": suffix_array_dedup,
    "op5_cross_entropy_difference": cross_entropy_difference,
    "op6_line_frequency_rules": line_frequency_rules,
    "op7_gear_chunk_dedup": gear_chunk_dedup,
    "op8_simhash_near_dedup": simhash_near_dedup,
    "op9_best_fit_token_rows": best_fit_token_rows,
    "op10_source_mixing": source_mixing,
    "op11_bit_sliced_search": bit_sliced_search,
    "op12_merkle_manifest": merkle_manifest,
    "op13_ngram_language_id": ngram_language_id,
}

ORACLES: dict[str, str] = {
    "op2_tree_merge_dedup": """
        WITH t AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents
        ), g AS (
          SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
          FROM t GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
          t.text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    "op11_bit_sliced_search": oracles.SEARCH,
    "op12_merkle_manifest": oracles.MANIFEST,
}
