"""Reproducible sampling: rows are ordered by a salted hash of their key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.operators.ranking import top_k


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def sample_n(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows in hash order: the same rows whatever the partitioning."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def sample_per_stratum(
    df: DataFrame, strata: Sequence[str], key: str, quota: int, seed: str = "0"
) -> DataFrame:
    return top_k(df, strata, [hash_order(key, seed), F.col(key)], quota, rank="sample_rank")
