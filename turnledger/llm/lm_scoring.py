"""Cross-entropy difference of matched n-gram models.

A target model (documents given as good) and a background model (all documents) are
bigram models with Dirichlet smoothing over their own unigrams. They are matched: the same
vocabulary and the same smoothing. Every word and every pair of neighbouring words of the
corpus has counts of its own, under a 64-bit hash; none is folded, dropped or sampled, so
what is gathered grows with the corpus.

Documents are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash. A block adds up
its own words and pairs and hands on its sorted distinct keys, cut into ranges of the key;
each range sums the keys of all blocks and answers the blocks that sent it some, in the order
of their keys, with the counts in the whole corpus. The totals of all words are summed once
and broadcast, two rows. A frequent word or pair costs one key a block, wherever it stands.
Blocks, ranges and their tasks grow in number with the text, not in size, and nothing is
gathered at the driver.

The score of a document is H_target - H_background in bits per token; lower is closer to
the target.

Defined results
    * A null or empty text has no tokens and null entropies and score.
    * Words are white-space separated runs, A-Z lower-cased; the first follows a start mark.
    * The vocabulary has ``2**WORD_BITS`` places, or as many as there are words if these are
      more; places without a word are words not seen.
    * Identifiers listed several times as target count once per document row; a null
      identifier is never a target.
    * Without any target document the target model is the uniform one.
    * Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import arrow_batches, text_of

WORD_BITS = 18
ALPHA = 0.1
MU = 200.0
BLOCK_BYTES = 8 << 20
PAIR_RANGE_BYTES = 8 << 20
WORD_RANGE_BYTES = 64 << 20
LEAST_BLOCKS = 8
AT_ONCE = 1 << 19
CACHED = 500_000
START = 0


class Words:
    """Word numbers of texts, 63-bit hashes; each word is hashed once while remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = 1 + xxhash.xxh64_intdigest(w) % ((1 << 63) - 1)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_cells(ids: np.ndarray) -> np.ndarray:
    """The key of each word with the one before it."""
    before = np.concatenate([[START], ids[:-1]]).astype(np.int64).view(np.uint64)
    mixed = _mixed(before + np.uint64(0x9E3779B97F4A7C15)) ^ ids.astype(np.int64).view(np.uint64)
    return _mixed(mixed).view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by significance, so that the empty ones lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    wide = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(wide.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_numbers(packed, "<u8"), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(_planes(counts.astype("<i8")), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    return _numbers(zlib.decompress(packed), "<i8") if packed else np.zeros(0, "<i8")


KEYS = "kind int, range int, block int, keys binary, background binary, target binary"
COUNTS = "block int, kind int, range int, background binary, target binary"
TOTALS = "kind int, n_words long, n_background long, n_target long"


def _ranges_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of ascending keys begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _keys_of_block(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts with a start mark for each, and all pairs, unsigned."""
    words = np.concatenate([*texts, np.zeros(len(texts), np.int64)]).view(np.uint64)
    return words, np.concatenate([pair_cells(x) for x in texts]).view(np.uint64)


def _counted(batches: Iterator[pa.RecordBatch], bits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each block of a partition with their counts in it."""
    words, good, held = Words(), defaultdict(set), defaultdict(list)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), texts, strict=True)
        for block, its_id, text in rows:
            if text is None:
                good[block].add(its_id)
            elif len(ids := words.of(text)):
                held[block].append((its_id, ids))
    for block in list(held):
        rows = held.pop(block)
        mine = good[block]
        everyone = _keys_of_block([x for _, x in rows])
        chosen = [x for i, x in rows if i in mine]
        targets = _keys_of_block(chosen) if chosen else (np.zeros(0, np.uint64),) * 2
        for kind in (0, 1):
            keys, n = np.unique(everyone[kind], return_counts=True)
            some, m = np.unique(targets[kind], return_counts=True)
            target = np.zeros(len(keys), np.int64)
            target[np.searchsorted(keys, some)] = m
            at = _ranges_of(keys, bits[kind])
            full = np.flatnonzero(np.diff(at))
            for s in range(0, len(full), 256):
                part = full[s : s + 256]
                packed = ((pack_keys, keys), (pack_counts, n), (pack_counts, target))
                cut = [[pack(x[at[r] : at[r + 1]]) for r in part] for pack, x in packed]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), kind, np.int32)),
                        pa.array(part.astype(np.int32)),
                        pa.array(np.full(len(part), block, np.int32)),
                        *(pa.array(c, pa.binary()) for c in cut),
                    ],
                    names=["kind", "range", "block", "keys", "background", "target"],
                )


def _totals(table: pa.Table) -> pa.Table:
    """The number of different words of one range and their totals; none for pairs."""
    kind = table.column("kind")[0].as_py()
    sums = [0, 0, 0]
    if kind == 0:
        theirs = [unpack_keys(k.as_py()) for k in table.column("keys")]
        sums[0] = int((np.unique(np.concatenate(theirs)) != START).sum())
        for i, c in enumerate(("background", "target"), 1):
            counts = (unpack_counts(x.as_py()) for x in table.column(c))
            sums[i] = sum(int(n[k != START].sum()) for k, n in zip(theirs, counts, strict=True))
    names = ["n_words", "n_background", "n_target"]
    return pa.table(
        {"kind": pa.array([kind], pa.int32())} | {n: pa.array([x], pa.int64()) for n, x in zip(names, sums, strict=True)}
    )


def _summed(table: pa.Table) -> pa.Table:
    """The counts of one range over all blocks, for each block those of its own keys."""
    kind, which = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
    theirs = [unpack_keys(k.as_py()) for k in table.column("keys")]
    sizes = [len(k) for k in theirs]
    keys, back = np.unique(np.concatenate(theirs), return_inverse=True)
    sums = []
    for c in ("background", "target"):
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, np.concatenate([unpack_counts(x.as_py()) for x in table.column(c)]))
        sums.append(total)
    ends = np.cumsum(sizes)
    made: dict[int, tuple] = {}
    for block, s, e in zip(table.column("block").to_pylist(), ends - sizes, ends, strict=True):
        made[block] = tuple(pack_counts(total[back[s:e]]) for total in sums)
    to = sorted(made)
    n = len(to)
    return pa.table(
        {
            "block": pa.array(to, pa.int32()),
            "kind": pa.array(np.full(n, kind, np.int32)),
            "range": pa.array(np.full(n, which, np.int32)),
            "background": pa.array([made[b][0] for b in to], pa.binary()),
            "target": pa.array([made[b][1] for b in to], pa.binary()),
        }
    )


def bits(word: np.ndarray, before: np.ndarray, pair: np.ndarray, total: float, mu: float = MU):
    """Bits of words under a model, from their counts, their histories' and their pairs'."""
    unigram = (word + ALPHA) / total
    return -np.log2((pair + mu * unigram) / (before + mu))


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Scores of the documents of a block from the corpus counts of its keys."""
    docs = docs.filter(pc.is_valid(docs.column("text")))
    words = Words()
    texts = [words.of(t) for c in docs.column("text").chunks for t in c.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(x) for x in texts], np.int64)
    entropy = np.full((2, len(texts)), np.nan)
    full = np.flatnonzero(sizes)
    if len(full):
        counts = counts.sort_by([("kind", "ascending"), ("range", "ascending")])
        kinds = counts.column("kind").to_numpy()
        of = {}
        for k in (0, 1):
            mine = counts.filter(pa.array(kinds == k))
            of[k] = [
                np.concatenate([unpack_counts(x.as_py()) for x in mine.column(c)]) for c in ("target", "background")
            ]
        keys = [np.unique(x) for x in _keys_of_block([texts[i] for i in full])]
        if any(len(keys[k]) != len(x) for k in (0, 1) for x in of[k]):
            raise ValueError("a block was not answered for all its words and pairs")
        # Every row of the words carries the corpus totals.
        whole = counts.slice(int(np.flatnonzero(kinds == 0)[0]), 1)
        n_words, *totals = (whole.column(c)[0].as_py() for c in ("n_words", "n_target", "n_background"))
        places = max(1 << WORD_BITS, n_words + 1) - 1
        totals = [t + ALPHA * places for t in totals]
        # Whole texts at a time, about AT_ONCE words of them.
        cut = np.cumsum(sizes[full]) // AT_ONCE
        for some in np.split(full, np.flatnonzero(np.diff(cut)) + 1):
            mine = [texts[i] for i in some]
            first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            word = np.searchsorted(keys[0], np.concatenate(mine).view(np.uint64))
            before = np.concatenate([[0], word[:-1]])
            before[first] = 0  # the start mark is the least key
            pair = np.searchsorted(keys[1], np.concatenate([pair_cells(x) for x in mine]).view(np.uint64))
            for m in (0, 1):
                lost = bits(of[0][m][word], of[0][m][before], of[1][m][pair], totals[m])
                entropy[m, some] = np.add.reduceat(lost, first) / sizes[some]
    none = sizes == 0
    return pa.table(
        {
            "id": docs.column("id"),
            "n_tokens": pa.array(sizes),
            "h_target": pa.array(entropy[0], mask=none),
            "h_background": pa.array(entropy[1], mask=none),
            "score": pa.array(entropy[0] - entropy[1], mask=none),
        }
    )


def score(
    df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_tokens, h_target, h_background, score.

    ``targets`` holds the identifiers of the target documents.
    """
    arrow_batches(df.sparkSession, rows=500, mbytes=8)
    slim = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))
    ranges = tuple(
        max(0, math.ceil(math.log2(max(1, size / most)))) for most in (WORD_RANGE_BYTES, PAIR_RANGE_BYTES)
    )
    # Labels go to the block of their documents, so a block knows its targets.
    good = targets.select(F.col(id_col).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"))
    dealt = slim.unionByName(good.filter("id is not null"))
    where = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    dealt = dealt.select(F.pmod(where, F.lit(blocks)).cast("int").alias("block"), "id", "text")
    # Both uses below read this one exchange.
    dealt = dealt.repartition(2 * blocks, "block")
    keys = dealt.mapInArrow(partial(_counted, bits=ranges), KEYS)

    def sums(table: pa.Table) -> pa.Table:
        return _summed(table)

    def totals(table: pa.Table) -> pa.Table:
        return _totals(table)

    def scores(docs: pa.Table, counts: pa.Table) -> pa.Table:
        return _scored(docs, counts)

    # Both read one exchange of the keys. The totals are two rows, one for words, one for pairs.
    by_range = keys.groupBy("kind", "range")
    whole = by_range.applyInArrow(totals, TOTALS).groupBy("kind")
    whole = whole.agg(*[F.sum(c).alias(c) for c in ("n_words", "n_background", "n_target")])
    counts = by_range.applyInArrow(sums, COUNTS).join(F.broadcast(whole), "kind")
    made = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        scores, f"id {kind}, n_tokens long, h_target double, h_background double, score double"
    )
    return made.withColumnRenamed("id", id_col)
