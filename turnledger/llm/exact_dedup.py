"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run of (digest, identifier) pairs, cut into digest ranges by its
leading bits. In each binomial round ``fan_in`` runs (a power of two) whose numbers differ in
the next bits send each range to one place, where it is sorted by digest and merged in that
order: equal digests follow each other, and the merge keeps for each the winning identifier,
the number of rows and two independent checks of the text (length and a second hash). The
merge is a sort aggregate, so it reads its runs in order and holds one digest at a time.
Copies are combined inside the task that reads them, so a digest has at most ``fan_in`` rows
in a merge however many copies there are.

Defined results
    * A null text counts as empty; all empty texts are one group.
    * Letters A-Z are lower-cased first; ``fold=False`` compares texts as they are.
    * Null identifiers lose to any other; in a group of only null identifiers ``keep_id``
      is null and ``kept`` is true for all its rows, since identifiers do not tell them apart.
    * A row repeated with its identifier is the same document listed twice: all its rows
      carry the same verdict. ``drop_copies`` keeps exactly one row of every group: of
      rows that share the winning identifier, null included, one.
    * Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import fold_ascii, one_of_each, store, text_of

RUNS = 256
FAN_IN = 16
RANGE_DIGITS = 3  # of the hex digest: 4,096 ranges, so a run spreads over many tasks


def digests(df: DataFrame, id_col: str, text_col: str, fold: bool = True) -> DataFrame:
    text = fold_ascii(text_of(text_col)) if fold else text_of(text_col)
    return df.select(F.col(id_col).alias("id"), text.alias("norm")).select(
        "id",
        F.sha2("norm", 256).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("mark"),
    )


def _merge(level: DataFrame) -> DataFrame:
    """One sorted run out of the runs that share a number, range by range.

    A struct has no buffer that a hash aggregate could change in place, so Spark sorts
    by range, run and digest and merges in that order.
    """
    return level.groupBy("range", "run", "digest").agg(
        F.min("winner").alias("winner"),
        F.sum("group_size").alias("group_size"),
        F.min("mark_lo").alias("mark_lo"),
        F.max("mark_hi").alias("mark_hi"),
        F.min("bytes_lo").alias("bytes_lo"),
        F.max("bytes_hi").alias("bytes_hi"),
    )


def tree_merge(
    rows: DataFrame, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """(digest, keep_id, group_size): the merged run. Fails if a check contradicts a digest."""
    order = {"max": F.bitwise_not(F.col("id")), "min": F.col("id")}[keep]
    level = rows.select(
        F.substring("digest", 1, RANGE_DIGITS).alias("range"),
        (F.spark_partition_id() % runs).alias("run"),
        "digest",
        F.struct(F.col("id").isNull().alias("none"), order.alias("order"), "id").alias("winner"),
        F.lit(1).cast("long").alias("group_size"),
        F.col("mark").alias("mark_lo"),
        F.col("mark").alias("mark_hi"),
        F.col("n_bytes").alias("bytes_lo"),
        F.col("n_bytes").alias("bytes_hi"),
    )
    level = _merge(level)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = _merge(level.repartition("range", "run"))
    same = (F.col("mark_lo") == F.col("mark_hi")) & (F.col("bytes_lo") == F.col("bytes_hi"))
    checked = F.when(same, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share a digest")).cast("long")
    )
    return level.select("digest", F.col("winner.id").alias("keep_id"), checked.alias("group_size"))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max"
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = store(digests(df, id_col, text_col), "digests")
    merged = tree_merge(rows, keep)
    return rows.join(merged, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max"
) -> DataFrame:
    """One row of every group of equal texts, with all its columns."""
    rows = store(digests(df, id_col, text_col), "digests")
    merged = store(tree_merge(rows, keep), "merged")
    twice = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    won = (twice["digest"] == merged["digest"]) & twice["id"].eqNullSafe(merged["keep_id"])
    repeats = store(twice.join(merged, won, "left_semi").select(F.col("digest").alias("__digest")), "repeats")
    kept = merged.select(
        F.col("digest").alias("__kept"), F.col("keep_id").alias("__keep_id")
    )
    here = df.withColumn("__digest", F.sha2(fold_ascii(text_of(text_col)), 256))
    met = (here["__digest"] == kept["__kept"]) & here[id_col].eqNullSafe(kept["__keep_id"])
    return one_of_each(here.join(kept, met, "left_semi"), ["__digest"], repeats).drop("__digest")
