"""Consecutive numbers along an order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import store

_ROW_BITS = 33  # Spark puts the partition above this many bits of its row numbers.


def part_of(seq: str = "seq") -> Column:
    return F.shiftright(seq, _ROW_BITS)


def in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The stored frame in range partitions of ``order`` with a rising row number ``seq``.

    The frame should be a stored one: the ranges are drawn from a sample of it and must
    not change if a task runs again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return store(ranged.withColumn("seq", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, order: Sequence[str], name: str, out: str) -> DataFrame:
    """Add the rank from 0 of every row along ``order``.

    Only a row per range partition meets in the window that adds up their sizes.
    """
    rows = in_order(df, order, name).withColumn("__part", part_of())
    sizes = rows.groupBy("__part").agg(F.min("seq").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__lo")).alias("__shift")
    )
    return rows.join(starts, "__part").withColumn(out, F.col("seq") + F.col("__shift")).drop(
        "__part", "__shift", "seq"
    )
