"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits, each the majority over the hashes of the text's word shingles.
Equal fingerprints are one from here on. Fingerprints within ``radius`` bits of each other
agree on at least ``blocks - radius`` of ``blocks`` blocks of bits, so each is filed once for
every such choice of blocks, and only fingerprints in one file meet.

Within a file the fingerprints are stored as bit planes: plane b holds bit b of 64 of them
in one word. A query is compared with 64 stored fingerprints by each word operation: its
difference planes go through carry-save adders into three bit-sliced counters, and a block
of words is abandoned once all its counters have passed the radius. A file gives a spanning
forest of its links, not its pairs. A file with more than ``FULL`` fingerprints is filed
again by ``radius + 1`` blocks of its other bits, one of which any two near fingerprints
share. Components of all links are found by contraction.

Defined results
    * A null text counts as empty: no words, fingerprint 0, linked like any other.
    * A text of fewer words than a shingle has one shingle, the whole sequence.
    * Null identifiers are no candidates for ``component_id``; a component of only null
      identifiers has a null one.
    * Rows that repeat an identifier each get a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import arrow_batches, one_of_each, store, text_of
from turnledger.llm.components import connected_components

BITS = 64
RADIUS = 4
SHINGLE = 4
BLOCKS = 7
FULL = 20_000
SEED = 42
WORDS_AT_ONCE = 1 << 17
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "<u8", n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        made = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in rest), made], names=[*rest, "fp"]
        )


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(id, text_key, fp) of every row, stored."""
    arrow_batches(df.sparkSession)
    text = text_of(text_col)
    slim = df.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )
    head = ", ".join(f"{n} {t}" for n, t in slim.drop("text").dtypes)
    made = slim.mapInArrow(lambda b: _fingerprints_of(b, shingle), f"{head}, fp long")
    return store(made, "fingerprints")


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal runs of the given bits."""
    return [sum(1 << b for b in run.tolist()) for run in np.array_split(np.array(bits), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One mask for every choice of ``blocks - radius`` blocks."""
    parts = _blocks(list(range(BITS)), blocks)
    return [sum(c) for c in combinations(parts, blocks - radius)]


def within(planes: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Words whose bits tell which stored fingerprints are within the radius of a query.

    ``planes`` and ``query`` are (64, ...) and broadcast against each other; a query plane is
    all ones where its bit is set.
    """
    shape = np.broadcast_shapes(planes.shape[1:], query.shape[1:])
    ones, twos, fours, far = (np.zeros(shape, np.uint64) for _ in range(4))

    def add_twos(x):
        nonlocal fours, far, twos
        carry = twos & x
        twos ^= x
        far |= fours & carry
        fours ^= carry

    for b in range(0, BITS, 2):
        # A full adder saves the carry of two differences and the standing ones.
        x, y = planes[b] ^ query[b], planes[b + 1] ^ query[b + 1]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        add_twos(carry)
        if b % 8 == 6:
            far |= _above(ones, twos, fours, radius)
            if b >= 14 and (far == ALL).all():
                break
    return ~(far | _above(ones, twos, fours, radius))


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Bits whose three-bit counter is above the radius."""
    out = np.zeros_like(ones)
    for value in range(radius + 1, 8):
        word = np.full_like(ones, ALL)
        for plane, bit in ((ones, 1), (twos, 2), (fours, 4)):
            word &= plane if value & bit else ~plane
        out |= word
    return out


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes of one file; lanes beyond its end are zero."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _spread(fps: np.ndarray) -> np.ndarray:
    """(64, n): all ones where a fingerprint has the bit."""
    return np.stack([((fps >> np.uint64(b)) & ONE) * ALL for b in range(BITS)])


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Least index of the component of each of n nodes, given edges and earlier parents."""
    parent = np.arange(n) if parent is None else parent
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _large_file(fps: np.ndarray, radius: int) -> np.ndarray:
    """The parents of one file's fingerprints, a block of queries at a time."""
    planes = _planes(fps)
    words = planes.shape[1]
    step = max(1, WORDS_AT_ONCE // words)
    parent = np.arange(len(fps))
    for at in range(0, len(fps), step):
        query = _spread(fps[at : at + step])[:, :, None]
        hits = within(planes[:, None, :], query, radius)
        bits = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        q, lane = np.nonzero(bits)
        parent = forest(len(fps), q + at, lane, parent)
    return parent


def _small_files(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """Edges (index, index) inside files of at most 64, all files of a size class at once."""
    at_a, at_b = [], []
    for lanes in (2, 4, 8, 16, 32, 64):
        mine = (sizes <= lanes) & (sizes > lanes // 2) & (sizes > 1)
        if not mine.any():
            continue
        first, count = starts[mine], sizes[mine]
        rows = np.minimum(first[:, None] + np.arange(lanes), len(fps) - 1)
        stored = fps[rows]
        planes = np.zeros((BITS, len(first)), np.uint64)
        for lane in range(lanes):
            there = np.where(lane < count, stored[:, lane], np.uint64(0))
            for b in range(BITS):
                planes[b] |= ((there >> np.uint64(b)) & ONE) << np.uint64(lane)
        for j in range(1, lanes):
            here = np.flatnonzero(count > j)
            if not len(here):
                break
            hits = within(planes[:, here], _spread(stored[here, j]), radius)
            for lane in range(j):
                hit = here[((hits >> np.uint64(lane)) & ONE).astype(bool)]
                at_a.append(first[hit] + lane)
                at_b.append(first[hit] + j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(at_a), np.concatenate(at_b)) if at_a else (none, none)


def links(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS):
    """Spanning links (fp, fp) of files given as runs of ``fps`` that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(fps)))
    parent = forest(len(fps), *_small_files(fps, starts, np.where(sizes <= 64, sizes, 0), radius))
    for first, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        parent[first : first + size] = first + _large_file(fps[first : first + size], radius)
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[parent[moved]], fps[moved]


def _links_of(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by file; a file may run over several batches."""
    tail: list[np.ndarray] = []
    held = 0

    def columns(batch):
        return np.stack([batch.column(i).to_numpy() for i in range(3)])

    def out(part, last):
        change = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])) + 1
        starts = np.concatenate([[0], change])
        upto = part.shape[1] if last else int(starts[-1])
        starts = starts[starts < upto]
        if len(starts):
            a, b = links(part[2, :upto].view(np.uint64).copy(), starts, radius)
            made = [pa.array(x.view(np.int64), pa.int64()) for x in (a, b)]
            return part[:, upto:], pa.RecordBatch.from_arrays(made, names=["a", "b"])
        return part[:, upto:], None

    for batch in batches:
        if batch.num_rows:
            tail.append(columns(batch))
            held += batch.num_rows
        if held >= 1 << 17:
            rest, made = out(np.concatenate(tail, axis=1), False)
            tail, held = [rest], 0 if made is not None else rest.shape[1] // 2
            if made is not None:
                yield made
    if tail and sum(t.shape[1] for t in tail):
        _, made = out(np.concatenate(tail, axis=1), True)
        if made is not None:
            yield made


def near_links(
    fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, full: int = FULL
) -> DataFrame:
    """Links (a, b) that join any two of the distinct fingerprints ``fp`` within the radius."""
    if not 0 < radius < 7 or not radius < blocks:
        raise ValueError("the radius must be from 1 to 6 and below the number of blocks")
    arrow_batches(fps.sparkSession, rows=50_000)
    chosen = masks(radius, blocks)
    filed = fps.select(
        F.col("fp"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("long").alias("file"),
                        F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"),
                    )
                    for i, m in enumerate(chosen)
                ]
            )
        ),
    )
    large = store(filed.groupBy("file", "key").count().filter(F.col("count") > full), "full-files")
    met = filed.join(large.withColumnRenamed("count", "n"), ["file", "key"], "left")
    again = []
    for i, m in enumerate(chosen):
        other = _blocks([b for b in range(BITS) if not m >> b & 1], radius + 1)
        again.append(
            F.array(
                *[
                    F.struct(
                        F.lit(len(chosen) + i * (radius + 1) + j).cast("long").alias("file"),
                        F.col("fp").bitwiseAND(F.lit(_signed(m | o))).alias("key"),
                    )
                    for j, o in enumerate(other)
                ]
            )
        )
    as_is = F.array(F.struct(F.col("file"), F.col("key")))
    finer = F.when(F.col("n").isNull(), as_is).otherwise(F.get(F.array(*again), F.col("file").cast("int")))
    rows = met.select("fp", finer.alias("to")).select("fp", F.inline("to"))
    rows = rows.repartition("file", "key").sortWithinPartitions("file", "key", "fp")
    return rows.select("file", "key", "fp").mapInArrow(
        lambda b: _links_of(b, radius), "a long, b long"
    )


def _grouped(
    df: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, blocks: int
) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, fp) of all rows, and (fp, root, component_id) of all fingerprints."""
    rows = fingerprints(df, id_col, text_col, shingle)
    distinct = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct, radius, blocks))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    known = store(known, "roots")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, store(known.join(named, "root").select("fp", "root", "component_id"), "components")


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per document: id, text_key, fingerprint, component_id."""
    rows, by_fp = _grouped(df, id_col, text_col, radius, shingle, blocks)
    return rows.join(by_fp, "fp").select(
        F.col("id").alias(id_col),
        "text_key",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row of every component, with all its columns: that of the least identifier, null
    last; of several rows with it the one whose text hashes lowest."""
    rows, by_fp = _grouped(df, id_col, text_col, radius, shingle, blocks)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    kept = rows.join(by_fp, "fp").groupBy("root").agg(first)
    kept = store(kept.select(F.col("first.id").alias("__id"), F.col("first.text_key").alias("__its_key")), "kept")
    here = df.withColumn("__text_key", F.xxhash64(text_of(text_col)))
    met = here[id_col].eqNullSafe(kept["__id"]) & (here["__text_key"] == kept["__its_key"])
    twice = rows.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    won = twice["id"].eqNullSafe(kept["__id"]) & (twice["text_key"] == kept["__its_key"])
    repeats = store(twice.join(kept, won, "left_semi").select(F.col("id").alias(id_col), F.col("text_key").alias("__text_key")), "repeats")
    return one_of_each(here.join(kept, met, "left_semi"), [id_col, "__text_key"], repeats).drop("__text_key")
