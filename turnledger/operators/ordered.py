"""Ordered operators that survive a hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here every key is
cut into slices of its own order (minutes of a trace, pages of turns): the window
runs inside ``(key, slice)``, and only one carry row per slice is put in order per
key. Results equal the plain window; the slice only decides how the work is spread.
The slice column must not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE = "__slice"


def time_slice(ts: str | Column, seconds: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def page_slice(position: str | Column, size: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("long")


def _inner(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, _SLICE).orderBy(*order)


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(_SLICE)


def lag(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[str],
    columns: Mapping[str, str],
    whole_min: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``out = previous value of in`` for every ``out: in`` of ``columns``.

    ``whole_min`` adds the key's minimum of further columns; it rides on the carry rows
    and costs no extra pass.
    """
    whole_min = whole_min or {}
    df = df.withColumn(_SLICE, slice_by)
    tails = df.groupBy(*keys, _SLICE).agg(
        *[F.max_by(F.struct(src), F.struct(*order)).alias(f"__t_{out}") for out, src in columns.items()],
        *[F.min(src).alias(f"__m_{out}") for out, src in whole_min.items()],
    )
    carry = tails.select(
        *keys,
        _SLICE,
        *[F.lag(f"__t_{out}").over(_across(keys)).alias(f"__c_{out}") for out in columns],
        *[F.min(f"__m_{out}").over(Window.partitionBy(*keys)).alias(out) for out in whole_min],
    )
    w = _inner(keys, order)
    inside = df.select(
        "*",
        F.row_number().over(w).alias("__rn"),
        *[F.lag(src).over(w).alias(f"__l_{out}") for out, src in columns.items()],
    )
    joined = inside.join(carry, [*keys, _SLICE], "left")
    first = F.col("__rn") == 1
    return joined.select(
        *df.drop(_SLICE).columns,
        *[
            F.when(first, F.col(f"__c_{out}.{src}")).otherwise(F.col(f"__l_{out}")).alias(out)
            for out, src in columns.items()
        ],
        *whole_min,
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[str],
    values: Mapping[str, Column],
    whole_sum: Mapping[str, str] | None = None,
    whole_max: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the inclusive running sum of every ``out: value`` along the order.

    ``whole_sum`` adds the key's total of some of these sums and ``whole_max`` the key's maximum
    of columns, each as ``out: in``; both ride on the carry rows and cost no further pass.
    """
    whole_sum, whole_max = whole_sum or {}, whole_max or {}
    columns = df.columns
    df = df.select("*", slice_by.alias(_SLICE), *[v.alias(f"__v_{out}") for out, v in values.items()])
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    before = (
        df.groupBy(*keys, _SLICE)
        .agg(
            *[F.sum(f"__v_{out}").alias(f"__s_{out}") for out in values],
            *[F.max(src).alias(f"__m_{out}") for out, src in whole_max.items()],
        )
        .select(
            *keys,
            _SLICE,
            *[F.coalesce(F.sum(f"__s_{out}").over(earlier), F.lit(0)).alias(f"__b_{out}") for out in values],
            *[F.sum(f"__s_{src}").over(everything).alias(out) for out, src in whole_sum.items()],
            *[F.max(f"__m_{out}").over(everything).alias(out) for out in whole_max],
        )
    )
    w = _inner(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.select(
        *columns, _SLICE, *[F.sum(f"__v_{out}").over(w).alias(f"__r_{out}") for out in values]
    )
    joined = inside.join(before, [*keys, _SLICE])
    return joined.select(
        *columns, *[(F.col(f"__r_{out}") + F.col(f"__b_{out}")).alias(out) for out in values], *whole_sum, *whole_max
    )


def positions(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], out: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sums(df, keys, slice_by, order, {out: F.lit(1).cast("long")})


def carry_forward(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Replace each column by its last non-null value so far (current row included)."""
    df = df.withColumn(_SLICE, slice_by)
    tails = df.groupBy(*keys, _SLICE).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__t_{c}")
            for c in columns
        ]
    )
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *keys, _SLICE, *[F.last(f"__t_{c}", ignorenulls=True).over(earlier).alias(f"__c_{c}") for c in columns]
    )
    w = _inner(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.select(
        *[c for c in df.columns if c not in columns],
        *[F.last(c, ignorenulls=True).over(w).alias(f"__l_{c}") for c in columns],
    )
    joined = inside.join(carry, [*keys, _SLICE], "left")
    return joined.select(
        *[
            F.coalesce(f"__l_{c}", f"__c_{c}").alias(c) if c in columns else F.col(c)
            for c in df.drop(_SLICE).columns
        ]
    )
