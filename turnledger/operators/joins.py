"""Joins that stay balanced when many rows have no key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_PARTS = 1024
FEW_ROWS = 100_000  # narrow rows that go along with every task


def few(table: DataFrame) -> DataFrame:
    """Let a table of few narrow rows travel to the rows it meets, not they to it.

    For tables that stay small while the other side grows; ``table`` is counted, so it should
    be a stored one. A larger one is left to Spark.
    """
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join to a table that is unique on ``key``.

    Rows without a key match nothing, yet a plain join would send them all to one task
    (anonymous callers may be a third of a log). A second join column deals them out by
    the hash of ``spread_by`` and is 0 for everybody else.
    """
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(NULL_PARTS))).otherwise(F.lit(0).cast("long"))
    left = rows.withColumn("__part", part)
    # always 0, but not a literal: the optimizer would turn that into a filter and join
    # on the key alone
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    right = table.where(F.col(key).isNotNull()).withColumn("__part", zero)
    return left.join(right, [key, "__part"], "left").drop("__part")
