"""Packing by optimal length buckets.

The lengths of all sequences form one histogram. A dynamic program over it chooses the
bucket bounds that minimise padding when every sequence is padded to its bucket's bound.
Inside a bucket, sequences follow each other in hashed order and every batch takes as many
as its token budget holds.

The histogram has at most ``max_len`` rows whatever the input: longer documents are cut
into pieces of ``max_len`` and a rest, so nothing is lost. A bucket may hold any share of
the rows: the place of a sequence in its bucket is the total of the slices before its own
plus its rank inside the slice.

Defined results
    * A null or negative length counts as zero. Such a document has one row with segment 0,
      no bucket and no batch, since it takes no room.
    * Rows that repeat an identifier are separate sequences; equal ones are interchangeable.
    * Only the identifier and the length are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import slice_of, store, unsigned_order

BUCKETS = 8
MAX_LEN = 2048
TOKEN_BUDGET = 16384


def optimal_bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Bucket bounds with the least padding, ascending, the last being the largest length.

    ``counts`` maps a length to its number of sequences. Bounds are lengths that occur:
    lowering a bound to the next length below it never adds padding.
    """
    lengths = np.array(sorted(k for k, v in counts.items() if v > 0), dtype=np.int64)
    if not len(lengths):
        return []
    number = np.array([counts[int(k)] for k in lengths], dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(number)])
    tokens = np.concatenate([[0.0], np.cumsum(number * lengths)])
    size = len(lengths)
    # best[j]: least padding of the first j lengths with the buckets used so far.
    best = np.concatenate([[0.0], lengths * n[1:] - tokens[1:]])
    cuts = [np.zeros(size + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, size)):
        nxt, cut = best.copy(), np.zeros(size + 1, dtype=np.int64)
        for j in range(1, size + 1):
            padded = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(padded))
            nxt[j] = padded[cut[j]]
        best = nxt
        cuts.append(cut)
    bounds, j = [], size
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(set(bounds))


def _segments(df: DataFrame, id_col: str, length: Column, max_len: int) -> DataFrame:
    sized = df.select(
        F.col(id_col).alias("id"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("whole"),
    )
    last = F.greatest(F.ceil(F.col("whole") / max_len) - 1, F.lit(0)).cast("long")
    cut = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    rest = F.col("whole") - F.col("segment") * max_len
    return cut.select("id", "segment", F.least(rest, F.lit(max_len)).alias("n_tokens"))


def pack(
    df: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    max_len: int = MAX_LEN,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per sequence: id, segment, n_tokens, bucket, bucket_len, batch, place, padding.

    ``place`` is the row of the sequence in its batch; batches are numbered per bucket.
    """
    if token_budget < max_len:
        raise ValueError("a batch must hold the longest sequence")
    hashed = F.xxhash64("id", "segment")
    rows = _segments(df, id_col, length, max_len).select(
        "*", unsigned_order(hashed).alias("h"), slice_of(hashed).alias("slice")
    )
    rows = store(rows, "segments")
    # At most max_len rows reach the driver.
    histogram = rows.filter("n_tokens > 0").groupBy("n_tokens").count().collect()
    bounds = optimal_bounds({r["n_tokens"]: r["count"] for r in histogram}, buckets)
    bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= b)
        bucket = F.when(fits, F.lit(i)).otherwise(bucket)
        bound = F.when(fits, F.lit(b).cast("long")).otherwise(bound)
    rows = rows.select("*", bucket.alias("bucket"), bound.alias("bucket_len"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = rows.filter("bucket is not null").groupBy("bucket", "slice").count()
    offsets = totals.select(
        "bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("bucket", "slice").orderBy("h", "id", "segment", "n_tokens")
    placed = rows.join(offsets, ["bucket", "slice"], "left").select(
        "*", (F.col("offset") + F.row_number().over(inside) - 1).alias("nth")
    )
    per_batch = F.floor(F.lit(token_budget) / F.col("bucket_len"))
    return placed.select(
        F.col("id").alias(id_col),
        "segment",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("nth") / per_batch).alias("batch"),
        (F.col("nth") % per_batch).alias("place"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
