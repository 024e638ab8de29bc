"""Mixing sources to target weights.

The words of every source form one stream, cut into blocks of fixed length. Each source
gets as many slots as its target holds blocks. The slots are dealt over output shards by a
multinomial draw (halved again and again, each half a binomial draw from hashed bits), so
every shard has random counts of its sources while the totals stay at the targets. The n-th
slot of a source reads the block that a pseudorandom permutation of the source's block
numbers names; when all blocks are used, the next epoch has a permutation of its own.
Slots and documents then meet by block number.

Targets: sources by code point, null last, weigh 5, 2, 1 in turn and share all words by
weight; a target stops at ``cap`` times its source's words and the excess is shared by
weight until no target is above.

Defined results
    * Size is the number of words; a null text has none, and a document without words takes
      part with size 0 and nothing taken.
    * A null source is a source of its own.
    * Blocks have ``block_words`` words; a source short of 256 such blocks is cut into 256
      shorter ones, so that rounding to whole blocks stays small.
    * Rows that repeat an identifier are separate documents of the mix.
    * Draws depend only on identifiers, sizes, sources and the seed: reruns agree.
    * The window that ranks sources has one row per source, not per document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.common import SPACE, one_of_each, slice_of, store, text_of, unsigned_order, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
LEAST_BLOCKS = 256
SLOTS_PER_SHARD = 4096
ROUNDS = 8
SEED = 20


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, s, source_size, target) from (source, source_size); s numbers the sources."""
    ranked = sizes.withColumn(
        "s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select(
        "*",
        F.get(weight, F.col("s") % len(weights)).alias("weight"),
        (F.col("source_size") * cap).cast("double").alias("most"),
    ).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy("level", "s").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = F.sum(F.col("source_size").cast("double")).over(everyone)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everyone) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    # The first source, by level, that need not stop at its cap sets the common level.
    ranked = ranked.withColumn("open", left / weights_left)
    free = F.when(F.col("open") <= F.col("level"), F.col("open"))
    ranked = ranked.withColumn("common", F.first(free, ignorenulls=True).over(everyone))
    shared = F.coalesce(F.col("common"), F.col("level")) * F.col("weight")
    return ranked.select("source", "s", "source_size", F.least("most", shared).alias("target"))


def _halved(n: Column, key: list[Column]) -> Column:
    """A draw of Binomial(n, 1/2) from hashed bits; beyond 4096 by its normal limit."""
    words = F.sequence(F.lit(0).cast("long"), F.floor((F.least(n, F.lit(4096)) - 1) / 64))
    bits = F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda acc, i: acc
        + F.bit_count(
            F.when((i + 1) * 64 <= n, F.xxhash64(*key, i)).otherwise(
                F.xxhash64(*key, i).bitwiseAND(_low_bits(n - i * 64))
            )
        ),
    )
    unit = lambda salt: (F.shiftrightunsigned(F.xxhash64(*key, F.lit(salt)), 11) + 0.5) / (1 << 53)
    normal = F.sqrt(-2 * F.log(unit("r"))) * F.cos(2 * math.pi * unit("a"))
    large = F.round(n / 2 + normal * F.sqrt(n.cast("double")) / 2).cast("long")
    drawn = F.when(n <= 0, F.lit(0).cast("long")).when(n <= 4096, bits).otherwise(large)
    return F.greatest(F.least(drawn, n), F.lit(0).cast("long"))


def _low_bits(k: Column) -> Column:
    """A mask of the k lowest bits, k from 1 to 63."""
    return (F.pow(F.lit(2.0), k).cast("long") - 1).cast("long")


def shard_draws(targets: DataFrame, shard_bits: int, seed: int = SEED) -> DataFrame:
    """(s, blocks, shard, count, offset): each shard's draw and the slots of s before it."""
    zero = F.lit(0).cast("long")
    draws = targets.select("s", "blocks", zero.alias("shard"), "slots", zero.alias("offset"))
    for bit in range(shard_bits):
        if bit % 8 == 7:
            draws = draws.repartition("s", "shard")
        key = [F.lit(seed), F.col("s"), F.lit(bit), F.col("shard")]
        draws = draws.withColumn("left", _halved(F.col("slots"), key))
        halves = F.array(
            F.struct(
                (F.col("shard") * 2).alias("shard"),
                F.col("left").alias("slots"),
                F.col("offset").alias("offset"),
            ),
            F.struct(
                (F.col("shard") * 2 + 1).alias("shard"),
                (F.col("slots") - F.col("left")).alias("slots"),
                (F.col("offset") + F.col("left")).alias("offset"),
            ),
        )
        draws = draws.select("s", "blocks", F.inline(halves))
    return draws


def permuted(df: DataFrame, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """Add ``block``: the image of ``at`` under the permutation of (s, epoch).

    Swap-or-not: every round pairs x with k - x and swaps the pair or not by one hashed bit
    of the pair, which is a bijection on any number of blocks.
    """
    n, key = F.col("blocks"), [F.lit(seed), F.col("s"), F.col("epoch")]

    def swap_or_not(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        bit = F.xxhash64(*key, -1 - r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    steps = F.sequence(F.lit(0), F.lit(rounds - 1))
    return df.withColumn("block", F.aggregate(steps, F.col("at"), swap_or_not))


def _plan(df: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int, seed: int):
    """(documents with their place in the stream, drawn blocks)."""
    text = text_of(text_col)
    hashed = F.xxhash64(F.lit(seed), F.col("id"))
    sized = store(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(text).alias("text_key"),
        ).select("*", unsigned_order(hashed).alias("h"), slice_of(hashed).alias("slice")),
        "sizes",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    length = F.least(
        F.lit(block_words),
        F.greatest(F.ceil(F.col("source_size") / LEAST_BLOCKS), F.lit(1)),
    ).cast("long")
    targets = targets.withColumn("block_len", length)
    targets = targets.withColumn(
        "blocks", F.ceil(F.col("source_size") / F.col("block_len")).cast("long")
    )
    slots = F.least(F.round(F.col("target") / F.col("block_len")).cast("long"), CAP * F.col("blocks"))
    targets = store(targets.withColumn("slots", slots).coalesce(1), "targets")

    here = sized.join(
        targets.withColumnRenamed("source", "its_source"),
        F.col("source").eqNullSafe(F.col("its_source")),
    ).drop("its_source")
    before = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        here.groupBy("s", "slice")
        .agg(F.sum("size").alias("words"))
        .select("s", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("s", "slice")
        .orderBy("h", "id", "size", "text_key")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = here.join(offsets, ["s", "slice"]).withColumn(
        "start", F.col("offset") + F.sum("size").over(inside) - F.col("size")
    )
    placed = placed.drop("offset", "slice", "h", "slots", "blocks")

    most, all_slots = targets.agg(F.max("slots"), F.sum("slots")).first()
    bits = max(3, math.ceil(math.log2(max(1, (most or 0) / SLOTS_PER_SHARD))))
    # A few draws stand for many slots: deal them by what they stand for.
    parts = max(8, math.ceil((all_slots or 0) / (8 * SLOTS_PER_SHARD)))
    draws = shard_draws(targets.filter("slots > 0"), bits, seed).repartition(parts, "s", "shard")
    nth = draws.filter("slots > 0").select(
        "s",
        "blocks",
        "shard",
        F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("slots") - 1)).alias("nth"),
    )
    slots = permuted(
        nth.select(
            "*",
            F.floor(F.col("nth") / F.col("blocks")).cast("long").alias("epoch"),
            (F.col("nth") % F.col("blocks")).alias("at"),
        ),
        seed,
    )
    return placed, slots


def drawn_blocks(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The slots of all shards: (s, shard, nth, epoch, block)."""
    slots = _plan(df, id_col, text_col, source_col, block_words, seed)[1]
    return slots.select("s", "shard", "nth", "epoch", "block")


def _pieces(placed: DataFrame) -> DataFrame:
    """A row for each block that a document reaches into: words lo to lo + n of the document."""
    end, length = F.col("start") + F.col("size"), F.col("block_len")
    first, last = F.floor(F.col("start") / length), F.floor((end - 1) / length)
    reached = F.when(F.col("size") > 0, F.sequence(first, last))
    pieces = placed.select("*", F.explode_outer(reached).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * length)
    hi = F.least(end, (F.col("block") + 1) * length)
    return pieces.select("*", (lo - F.col("start")).alias("lo"), (hi - lo).alias("n"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken."""
    placed, slots = _plan(df, id_col, text_col, source_col, block_words, seed)
    # Stored: Spark cannot guess how many slots a draw makes and would broadcast them.
    uses = store(slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("uses")), "uses")
    taken = _pieces(placed).join(uses, ["s", "block"], "left")
    return (
        taken.groupBy("s", "start", "id", "size", "text_key", "source", "source_size", "target")
        .agg(F.sum(F.coalesce(F.col("n") * F.col("uses"), F.lit(0))).cast("long").alias("taken"))
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("source").alias(source_col),
            "source_size",
            "target",
            "taken",
        )
    )


def mixed_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself with the columns of ``df``: a row for each epoch that drew from a document.

    Its text holds the words drawn in that epoch: the text as it was if all were drawn, else
    the drawn runs of words joined by blanks. Rows that repeat an identifier, a source and a
    text are drawn from as often as they stand there. Documents of which nothing was drawn
    are not in the mix.
    """
    placed, slots = _plan(df, id_col, text_col, source_col, block_words, seed)
    placed = placed.filter("size > 0")
    slots = store(slots.select("s", "epoch", "block"), "slots")
    drawn = _pieces(placed).join(slots, ["s", "block"])
    own = ("id", "source", "text_key")
    ranges = drawn.groupBy("s", "start", *own, "size", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("__runs"), F.sum("n").alias("__words")
    )
    ranges = store(ranges.drop("s", "start", "epoch"), "ranges")
    ranges = ranges.withColumnsRenamed({c: f"__{c}" for c in (*own, "size")})
    # A copy is no other text: its ranges meet a single row, not every copy.
    twice = placed.groupBy(*own).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    names = dict(zip(own, (id_col, source_col, "__its_key"), strict=True))
    repeats = store(twice.select(*[F.col(c).alias(n) for c, n in names.items()]), "repeats")
    here = one_of_each(df.withColumn("__its_key", F.xxhash64(text_of(text_col))), [*names.values()], repeats)
    met = [here[n].eqNullSafe(ranges[f"__{c}"]) for c, n in names.items()]
    words = F.split(F.regexp_replace(text_of(text_col), rf"^{SPACE}", ""), SPACE)
    joined = here.join(ranges, met).withColumn("__all", words)
    part = F.array_join(
        F.transform(
            "__runs",
            lambda r: F.array_join(
                F.slice(F.col("__all"), (r["lo"] + 1).cast("int"), r["n"].cast("int")), " "
            ),
        ),
        " ",
    )
    whole = F.col("__words") == F.col("__size")
    out = joined.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(df.dtypes)["n_chars"]))
    return out.select(*df.columns)
