"""A stored inverted index of passages whose blocks can be skipped.

Passages are put in an order in which neighbours are alike (by their commonest word, then by
length) and cut into blocks. The posting table has one row per block and term: the highest
impact of the term in the block, which is BM25 without the rarity of the term, and the
passages of the block that hold it. Files are sorted by block, so the rows of a block lie
together. Bounds are read from the narrow columns; only rows of blocks that can still reach a
query's result are opened.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.text import unroll, words
from turnledger.operators.joins import few
from turnledger.operators.ranking import top_k
from turnledger.session import scratch, stored

FORMAT = 1  # of the stored tables
BM25_K1, BM25_B = 1.2, 0.75
BLOCK_BITS = 4  # 16 passages
HEAD_BLOCKS = 8  # scored first, to find a score that the k-th result has at least
ROUNDING = 1e-6  # scores are rounded to six places, so a bound may lie below by as much


@dataclass(frozen=True)
class PassageIndex:
    postings: DataFrame  # block, term, best, postings<passage_id, tf, length, distinct_words>
    terms: DataFrame  # term, df
    passages: int
    mean_length: float


def impact(tf: Column, length: Column, mean_length: float) -> Column:
    """BM25 of a term without its rarity: grows with ``tf``."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(mean_length)))


def write_index(passages: DataFrame, root: str) -> None:
    """Write the index of ``(passage_id, content)``. Its summary is written last: a folder
    without one is not an index.

    Passages are put in order by narrow rows that carry no words, and only those are kept in
    order; the words move once, by block. Texts meet by ``passage_id`` before they are cut,
    since a text is shorter than the list of its words.
    """
    spark = passages.sparkSession
    # in a struct, a missing identifier is one like any other
    texts = passages.select(F.struct("passage_id").alias("key"), "content").repartition("key")
    spoken = texts.select("key", unroll(words("content")).alias("term")).where(F.col("term").isNotNull())
    counted = spoken.groupBy("key", "term").agg(F.count("*").alias("tf"))
    whole = counted.groupBy("key").agg(
        F.sum("tf").alias("length"),
        F.count("*").alias("distinct_words"),
        F.max_by("term", F.struct("tf", "term")).alias("commonest"),
    )
    alike = stored(whole.select("key.passage_id", *whole.columns[1:]), "alike").repartitionByRange("commonest", "length", "passage_id").sortWithinPartitions(
        "commonest", "length", "passage_id"
    )
    numbered = alike.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    numbered.drop("commonest").write.parquet(f"{root}/passages")
    forward = spark.read.parquet(f"{root}/passages")
    rows = passages.count()
    words_read = forward.agg(F.sum("length")).first()[0] or 0
    mean_length = words_read / rows if rows else 0.0
    placed = forward.withColumn("key", F.struct("passage_id"))
    blocks = (
        counted.join(placed.hint("shuffle_hash"), "key")
        .repartition("block")
        .groupBy("block", "term")
        .agg(
            F.max(impact(F.col("tf"), F.col("length"), mean_length)).alias("best"),
            F.collect_list(F.struct("passage_id", "tf", "length", "distinct_words")).alias("postings"),
        )
    )
    blocks.sortWithinPartitions("block", "term").write.parquet(f"{root}/postings")
    postings = spark.read.parquet(f"{root}/postings")
    postings.groupBy("term").agg(F.sum(F.size("postings")).alias("df")).write.parquet(f"{root}/terms")
    summary = spark.range(1).select(F.lit(rows).cast("long").alias("passages"), F.lit(float(mean_length)).alias("mean_length"))
    summary.coalesce(1).write.parquet(f"{root}/summary")


def open_index(spark: SparkSession, root: str) -> PassageIndex:
    summary = spark.read.parquet(f"{root}/summary").first()
    return PassageIndex(
        spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/terms"), summary["passages"], summary["mean_length"]
    )


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the files of a table as they are now: paths, sizes and times of change."""
    files = spark.read.parquet(path).select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    )
    rows = files.distinct().agg(F.array_sort(F.collect_list(F.concat_ws("|", *files.columns)))).first()[0]
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:24]


def index_of(spark: SparkSession, path: str, passages: DataFrame) -> PassageIndex:
    """The index of the passages read from ``path``, built once for the files as they are.

    It lies in the shared scratch folder under the files' fingerprint, so a changed table
    gets a new one. Every builder writes a folder of its own and nobody replaces one, so a
    reader never loses files; the owner of the scratch folder decides when old ones go.
    """
    root = f"{scratch(spark)}/passage-index-{FORMAT}-{fingerprint(spark, path)}"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/summary/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if done is not None and len(done):
        return open_index(spark, done[0].getPath().getParent().getParent().toString())
    own = f"{root}/{uuid.uuid4().hex}"
    write_index(passages, own)
    return open_index(spark, own)


# --- queries ----------------------------------------------------------------------


def weighted_terms(index: PassageIndex, queries: DataFrame) -> DataFrame:
    """(query_id, query_words, term, idf) of the queries' words that any passage holds."""
    spoken = queries.select("query_id", F.array_distinct(words("query")).alias("w"))
    terms = spoken.select("query_id", F.size("w").alias("query_words"), F.explode("w").alias("term"))
    rarity = F.ln(1 + (F.lit(index.passages) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(index.terms, "term").select("query_id", "query_words", "term", rarity.alias("idf"))


def score(index: PassageIndex, asked: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """``(query_id, passage_id, bm25, semantic, coverage)`` of the passages that share a
    word with a query, or of those in the ``reached`` (query_id, block) pairs only.

    Posting rows meet the query words and move once, by block; after that a block's pairs
    are made and summed where they are. The queries that reach a block come to it as one list,
    so that its postings are not sent out again for each of them.
    """
    rows = index.postings.select("block", "term", "postings")
    rows = rows.join(few(asked.select("term").distinct()), "term", "left_semi").repartition("block")
    if reached is not None:
        by = reached.groupBy("block").agg(F.collect_set("query_id").alias("by"))
        rows = rows.join(by.hint("shuffle_hash"), "block")
    rows = rows.join(few(asked), "term")
    if reached is not None:
        rows = rows.where(F.array_contains("by", F.col("query_id")))
    each = rows.select("block", "query_id", "query_words", "idf", F.inline("postings"))
    part = F.col("idf") * impact(F.col("tf"), F.col("length"), index.mean_length)
    summed = each.groupBy("block", "passage_id", "query_id", "query_words", "distinct_words").agg(
        F.sum(part).alias("bm25"), F.count("*").alias("shared")
    )
    return summed.select(
        "query_id",
        "passage_id",
        F.round("bm25", 6).alias("bm25"),
        F.round(F.col("shared") / F.sqrt(F.col("query_words") * F.col("distinct_words")), 6).alias("semantic"),
        F.round(F.col("shared") / F.col("query_words"), 6).alias("coverage"),
    )


def block_bounds(index: PassageIndex, asked: DataFrame) -> DataFrame:
    """(query_id, block, bound): no passage of the block scores more. A block's rows lie in
    one file, so the sums are made before anything moves."""
    met = index.postings.select("block", "term", "best").join(few(asked), "term")
    return met.groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))


def reached_blocks(index: PassageIndex, asked: DataFrame, k: int) -> DataFrame:
    """The (query_id, block) pairs that can hold one of a query's ``k`` best passages.

    The blocks with the highest bounds are scored first. The k-th best score in them is
    one that the k-th result has at least, and a block below it is never opened. A query
    with fewer than ``k`` scored passages so far keeps all its blocks.
    """
    bounds = stored(block_bounds(index, asked), "bounds")
    head = top_k(bounds, ["query_id"], [F.desc("bound"), "block"], max(HEAD_BLOCKS, -(-2 * k >> BLOCK_BITS)))
    seen = score(index, asked, stored(head.drop("rank"), "head")).select("query_id", "passage_id", "bm25")
    least = top_k(seen, ["query_id"], [F.desc("bm25"), "passage_id"], k).where(F.col("rank") == k)
    met = bounds.join(least.select("query_id", F.col("bm25").alias("least")), "query_id", "left")
    return stored(met.where(F.col("least").isNull() | (F.col("bound") + ROUNDING >= F.col("least"))), "reached")


def best_passages(index: PassageIndex, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best passages of every query by exact BM25."""
    asked = stored(weighted_terms(index, queries), "asked")
    found = score(index, asked, reached_blocks(index, asked, k)).select("query_id", "passage_id", "bm25")
    return top_k(found, ["query_id"], [F.desc("bm25"), "passage_id"], k)
