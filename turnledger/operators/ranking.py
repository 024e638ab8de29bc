"""Ranks, percentiles and top-k that never gather a group in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_BITS = 10


def nearest_rank(
    hist: DataFrame, keys: Sequence[str], value: str, weight: str, percentiles: Mapping[str, float]
) -> DataFrame:
    """Exact nearest-rank percentiles per key from a ``(key, value, weight)`` histogram.

    The element taken is number ``rint(p * (n - 1))`` (halves to even) of the sorted
    values. The histogram is first summed into blocks of 1,024 values; the block that
    holds the rank is found on those sums and only that block is ordered, so no task
    sorts more than the block list of a key or one block.
    """
    keys = list(keys)
    hist = hist.select(*keys, F.col(value).alias("__v"), F.col(weight).alias("__n")).withColumn(
        "__b", F.shiftright("__v", _BUCKET_BITS)
    )
    blocks = hist.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select(
        *keys,
        "__b",
        F.sum("__n").over(upto).alias("__hi"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        "__n",
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    (F.rint(F.lit(p) * (F.col("__total") - 1)) + 1).cast("long").alias("rank"),
                )
                for name, p in percentiles.items()
            ]
        )
    )
    targets = (
        blocks.select(*keys, "__b", "__hi", "__n", wanted.alias("w"))
        .where((F.col("w.rank") <= F.col("__hi")) & (F.col("w.rank") > F.col("__hi") - F.col("__n")))
        .select(
            *keys,
            "__b",
            F.col("w.name").alias("__name"),
            (F.col("w.rank") - F.col("__hi") + F.col("__n")).alias("__rank"),
        )
    )
    inside = Window.partitionBy(*keys, "__b", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        hist.join(targets, [*keys, "__b"])
        .withColumn("__cum", F.sum("__n").over(inside))
        .where(F.col("__cum") >= F.col("__rank"))
    )
    return found.groupBy(*keys).agg(
        *[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in percentiles]
    )


def with_ranks(slim: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Prepare a histogram (one row per key and value, with any other counters) for
    ``at_rank``, so that sums and percentiles come out of one aggregation. Only positive
    values are ranked. Values are ordered inside blocks of 1,024, and only the block
    totals of a key meet in one task."""
    keys = list(keys)
    counted = F.when(F.col(value) > 0, F.col(weight)).otherwise(0)
    slim = slim.select("*", F.shiftright(value, _BUCKET_BITS).alias("__b"), counted.alias("__c"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        slim.groupBy(*keys, "__b")
        .agg(F.sum("__c").alias("__c"))
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            F.col("__b").alias("__k_b"),
            F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__c").over(Window.partitionBy(*keys)).alias("__measured"),
        )
    )
    met = F.col("__b").eqNullSafe(F.col("__k_b"))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slim.join(blocks, met)
        .withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))
        .drop("__b", "__c", "__before", "__k_b", *[f"__k_{k}" for k in keys])
    )


def at_rank(value: str, p: float) -> Column:
    """Aggregate: the nearest-rank percentile of a frame made by ``with_ranks``."""
    rank = F.rint(F.lit(p) * (F.col("__measured") - 1)) + 1
    return F.min(F.when((F.col(value) > 0) & (F.col("__upto") >= rank), F.col(value)))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    The literal bound lets Spark put a group limit before the exchange, so each task
    ships at most ``k`` rows per key whatever the size of the group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= F.lit(k))
