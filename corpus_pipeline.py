"""From documents to packed batches: rules, copies, near copies, mix, packing.

Every stage works on all that the one before it kept. All but the last return the columns
of ``documents``; the last gives the place of every sequence in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import exact_dedup, mixing, packing, quality, simhash
from turnledger.llm.common import documents, store, text_of, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that are frequent on their host."""
    return quality.clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return simhash.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and epoch it was drawn in."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in token-budget batches of their length bucket."""
    return packing.pack(docs, word_count(text_of("text")))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("packing", packed),
]

# Shingle votes, line sketches, drawn blocks and the bucket program are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, name.replace(" ", "-"))
    return docs
