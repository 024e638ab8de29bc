"""Ranked lexical search over bit-sliced Bloom signatures.

The index. Documents are gathered into blocks of up to 512 rows of similar length. A block
stores a bit matrix whose columns are documents and whose rows, the slices, are positions of a
Bloom filter: a term sets three positions in its document's column. There is one matrix for
each of a few term frequencies (terms found once or more, twice or more, ...). The index also
holds the document frequency of every term, the lengths and the number of documents; it knows
nothing of the queries.

The search. For a block, the slices of a query term are joined by bitwise AND into the bitmap
of the documents that may hold it as often as that. A Bloom filter never misses a term, so the
sum of these bitmaps, each weighted by the term's weight and by the most that the frequency
can be worth in a document of that length, is an upper bound of the score. The documents with
the highest bounds are scored exactly from their texts, which gives each query a score that its
k-th result has at least; all documents whose bound reaches it, ties included, are then scored
exactly. What is left out is proven to be below the k-th result.

Queries are a stated set. They are taken in blocks of bounded size, so any number of them may be
asked; the index is built once. What comes back is exact for every length and every number
of copies: there is no cap on candidates.

Defined results
    * A text's terms are its longest runs of ASCII letters and digits and of all characters
      beyond ASCII; A-Z are lower-cased. A null text has none.
    * Documents and queries without a term have no results; scores are above 0.
    * Equal scores go by identifier, null first. Every row of the documents is a result of
      its own, rows that repeat an identifier and a text included, and so is every query row.
    * Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.llm.common import arrow_batches, store
from turnledger.operators.ranking import top_k

K = 50
ROWS = 512  # documents of a block
HELD_ROWS, HELD_TERMS = 4096, 2_000_000  # gathered in a task before blocks are cut
BLOCK_BITS = 1 << 23
TERM_BITS = 8  # of a signature per term, rounded up to a power of two for the block
HASHES = 3
TIMES = (1, 2, 3, 4, 6, 10)  # a layer of signatures for terms found so often or more
KNOWN = 500_000  # terms remembered in a worker
QUERY_ROWS, QUERY_TERMS = 512, 100_000  # of a block of queries
BROADCAST_BYTES = 8 << 20

# Everything but letters, digits and bytes beyond ASCII parts terms.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_INDEX = (
    "docs int, total long, ids array<long>, marks array<long>, lengths array<long>, "
    "layers array<int>, slices binary, term binary, df long"
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Hashes(dict):
    """64-bit hashes of terms; forgets all when it has grown too large."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term)
        return value


def _positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """The slices of terms in a filter of ``width`` (a power of two): (hash, term)."""
    one, two = hashes, (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) & np.uint64(width - 1) for i in range(HASHES)]).astype(np.int64)


def _width(most: int) -> int:
    return max(64, 1 << (TERM_BITS * most - 1).bit_length())


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar size for one block each, within its rows and its bits."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    for end in range(1, len(order) + 1):
        if end < len(order) and end - start < ROWS and (end + 1 - start) * _width(int(sizes[order[end]])) <= BLOCK_BITS:
            continue
        yield order[start:end]
        start = end


def _block(group: np.ndarray, docs: list[tuple]) -> pa.RecordBatch:
    """A block of documents (id, mark, length, hashes, frequencies)."""
    rows = [docs[g] for g in group]
    slot = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    hashes, times = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
    columns = -(-len(rows) // 8) * 8
    layers, slices = [], []
    for least in TIMES:
        on = times >= least
        slot, hashes, times = slot[on], hashes[on], times[on]
        if not len(slot):
            break
        width = _width(int(np.bincount(slot).max()))
        bits = np.zeros((width, columns), bool)
        for positions in _positions(hashes, width):
            bits[positions, slot] = True
        layers.append(width)
        slices.append(np.packbits(bits, axis=1).tobytes())
    return _index_rows(
        docs=[len(rows)],
        total=[sum(r[2] for r in rows)],
        ids=[[r[0] for r in rows]],
        marks=[[r[1] for r in rows]],
        lengths=[[r[2] for r in rows]],
        layers=[layers],
        slices=[b"".join(slices)],
    )


def _index_rows(**columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds |= {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    size = len(next(iter(columns.values())))
    fields = [f.split() for f in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(name, [None] * size), kinds[kind]) for name, kind in fields], names=[n for n, _ in fields]
    )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, spread = Hashes(), Counter()
    docs: list[tuple] = []
    held = 0

    def blocks() -> Iterator[pa.RecordBatch]:
        for group in _groups(np.array([len(d[3]) for d in docs])):
            yield _block(group, docs)

    def frequencies() -> Iterator[pa.RecordBatch]:
        found = list(spread.items())
        spread.clear()
        for at in range(0, len(found), 50_000):
            some = found[at : at + 50_000]
            yield _index_rows(term=[t for t, _ in some], df=[n for _, n in some])

    for batch in batches:
        for key, mark, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            words = terms(text)
            if not words:
                continue
            counts = Counter(words)
            spread.update(counts.keys())
            hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
            docs.append((key, mark, len(words), hashes, np.fromiter(counts.values(), np.int64, len(counts))))
            held += len(counts)
            if len(docs) >= HELD_ROWS or held >= HELD_TERMS:
                yield from blocks()
                docs.clear()
                held = 0
            if len(spread) >= KNOWN:
                yield from frequencies()
    if docs:
        yield from blocks()
    yield from frequencies()


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): a row's key, which with equal keys has equal texts."""
    text = F.col(text_col).cast("string")
    return df.where(text.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text")
    )


@dataclass(frozen=True)
class Index:
    """Stored signatures of blocks, the document frequency of every term, and totals."""

    blocks: DataFrame
    spread: DataFrame
    docs: int
    length: int


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    arrow_batches(df.sparkSession, rows=1000)
    rows = store(_texts(df, id_col, text_col).mapInArrow(_indexed, _INDEX), "signatures")
    blocks = rows.where("docs IS NOT NULL").drop("term", "df")
    spread = rows.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    totals = blocks.agg(F.sum(F.col("docs").cast("long")).alias("docs"), F.sum("total").alias("length")).first()
    return Index(blocks, store(spread, "frequencies"), totals["docs"] or 0, totals["length"] or 0)


@dataclass(frozen=True)
class Asked:
    """A block of queries: their terms, once each, as positions in one list of terms."""

    terms: list[bytes]
    weights: np.ndarray
    members: np.ndarray  # positions, query after query
    starts: np.ndarray
    docs: int
    length: int

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 50 + (50 * lengths * self.docs) // self.length

    @staticmethod
    def worth(times: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * times) // (1000 * times + 20 * norms)


def ask(index: Index, queries: list[list[bytes]]) -> Asked:
    """Look up the weights of all terms of a block of queries. Terms of no document go."""
    spark = index.spread.sparkSession
    wanted = sorted({t for q in queries for t in q})
    frame = spark.createDataFrame([(bytearray(t),) for t in wanted], "term binary")
    found = {bytes(r["term"]): r["df"] for r in index.spread.join(frame, "term").collect()}
    held = [t for t in wanted if t in found]
    place = {t: i for i, t in enumerate(held)}
    rows = [[place[t] for t in dict.fromkeys(q) if t in place] for q in queries]
    weights = [math.floor(1000 * math.log((2 * index.docs + 2) / (2 * found[t] + 1))) for t in held]
    return Asked(
        held,
        np.array(weights, np.int64),
        np.array([i for r in rows for i in r], np.int64),
        np.cumsum([0] + [len(r) for r in rows]),
        index.docs,
        index.length,
    )


class Bounds:
    """Upper bounds of all queries' scores for the documents of a block."""

    def __init__(self, asked: Asked):
        self.asked = asked
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in asked.terms], np.uint64)
        self.some = np.flatnonzero(np.diff(asked.starts))  # queries with a known term
        total = np.add.reduceat(asked.weights[asked.members], asked.starts[self.some]) if len(self.some) else np.zeros(1)
        # sums of weights are exact in this type
        self.kind = np.float32 if total.max() < 1 << 24 else np.float64
        self.member_query = np.repeat(np.arange(len(asked.starts) - 1), np.diff(asked.starts))

    def of(self, lengths: np.ndarray, layers: list[int], slices: np.ndarray) -> np.ndarray:
        """(query, document) bounds."""
        asked, stride = self.asked, -(-len(lengths) // 8)
        norms = asked.norms(lengths)
        bounds = np.zeros((len(asked.starts) - 1, len(lengths)))
        members, owner, kept, before, at = asked.members, self.member_query, None, 0, 0
        for i, width in enumerate(layers):
            layer = slices[at : at + width * stride].reshape(width, stride)
            at += width * stride
            maps = np.bitwise_and.reduce(layer[_positions(self.hashes, width)], axis=0)
            if kept is not None:
                maps &= kept
            kept = maps
            used = maps.any(axis=1)
            here = used[members]
            members, owner = members[here], owner[here]
            if not len(members):
                break
            row = np.cumsum(used) - 1
            weighted = np.unpackbits(maps[used], axis=1, count=len(lengths)).astype(self.kind)
            weighted *= asked.weights[used].astype(self.kind)[:, None]
            opens = np.flatnonzero(np.diff(owner, prepend=-1))
            sums = np.add.reduceat(weighted[row[members]], opens, axis=0)
            most = np.minimum(lengths, TIMES[i + 1] - 1) if i + 1 < len(TIMES) else lengths
            worth = asked.worth(most, norms)
            bounds[owner[opens]] += sums * (worth - before).astype(np.float64)
            before = worth
        return bounds


def _each_block(batches: Iterable[pa.RecordBatch], bounds: Bounds) -> Iterator[tuple]:
    for batch in batches:
        for ids, marks, lengths, layers, slices in zip(
            *(batch.column(c) for c in ("ids", "marks", "lengths", "layers", "slices")), strict=True
        ):
            data = np.frombuffer(slices.as_buffer(), np.uint8)
            found = bounds.of(np.array(lengths.as_py(), np.int64), layers.as_py(), data)
            yield np.array(ids.as_py(), object), np.array(marks.as_py(), np.int64), found


_PAIRS = "query int, id long, mark long, bound long"


def _pairs(query: np.ndarray, ids: np.ndarray, marks: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int32()), pa.array(list(ids), pa.int64()), pa.array(marks, pa.int64()), pa.array(bound.astype(np.int64))],
        names=["query", "id", "mark", "bound"],
    )


def _highest(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """The k highest bounds of every query in the blocks of a task."""
    bounds = Bounds(sent.value)
    best = ids = marks = None
    for i, m, found in _each_block(batches, bounds):
        i, m = np.broadcast_to(i, found.shape), np.broadcast_to(m, found.shape)
        if best is not None:
            found, i, m = np.hstack([best, found]), np.hstack([ids, i]), np.hstack([marks, m])
        if found.shape[1] > k:
            top = np.argpartition(-found, k - 1, axis=1)[:, :k]
            found, i, m = (np.take_along_axis(x, top, axis=1) for x in (found, i, m))
        best, ids, marks = found, i, m
    if best is not None:
        query, column = np.nonzero(best > 0)
        yield _pairs(query, ids[query, column], marks[query, column], best[query, column])


def _reaching(batches: Iterator[pa.RecordBatch], sent, least) -> Iterator[pa.RecordBatch]:
    """All pairs whose bound reaches the query's least score."""
    bounds = Bounds(sent.value)
    for ids, marks, found in _each_block(batches, bounds):
        query, column = np.nonzero(found >= least[:, None])
        if len(query):
            yield _pairs(query, ids[column], marks[column], found[query, column])


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    asked: Asked = sent.value
    place = {t: i for i, t in enumerate(asked.terms)}
    worth = np.zeros(len(asked.terms) + 1, np.int64)
    for batch in batches:
        out: list[list] = [[], [], []]
        for key, text, queries in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "queries")), strict=True):
            words = terms(text)
            held = [(place[t], n) for t, n in Counter(words).items() if t in place]
            at, times = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            worth[at] = asked.weights[at] * asked.worth(times, asked.norms(np.array([len(words)])))
            for q in queries:
                score = int(worth[asked.members[asked.starts[q] : asked.starts[q + 1]]].sum())
                if score > 0:
                    for column, value in zip(out, (q, key, score), strict=True):
                        column.append(value)
            worth[at] = 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
            names=["query", "id", "score"],
        )


def _rescore(texts: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """(query, id, score) of all rows whose key is among the pairs.

    The keys are broadcast while their stored size is below a fixed bound, else both
    sides meet by a shuffle.
    """
    keys = pairs.groupBy("id", "mark").agg(F.collect_set("query").alias("queries"))
    keys = store(keys.withColumnsRenamed({"id": "i", "mark": "m"}), "candidates")
    size = keys.agg(F.sum(32 + 4 * F.size("queries"))).first()[0] or 0
    side = F.broadcast(keys) if size <= BROADCAST_BYTES else keys
    met = texts.join(side, texts["id"].eqNullSafe(side["i"]) & (texts["mark"] == side["m"]))
    arrow_batches(texts.sparkSession, rows=1000)
    return met.select("id", "text", "queries").mapInArrow(partial(_scored, sent=sent), "query int, id long, score long")


def _search(index: Index, texts: DataFrame, asked: Asked, k: int) -> DataFrame:
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(asked)
    arrow_batches(spark, rows=16, mbytes=16)
    high = index.blocks.mapInArrow(partial(_highest, sent=sent, k=2 * k), _PAIRS)
    high = top_k(high, ["query"], [F.desc("bound"), "id", "mark"], 2 * k).drop("rank")
    order = [F.desc("score"), F.asc("id")]
    first = top_k(_rescore(texts, high, sent), ["query"], order, k).where(F.col("rank") == k)
    least = np.ones(len(asked.starts) - 1, np.int64)
    for row in first.select("query", "score").collect():  # a row per query of the block
        least[row["query"]] = row["score"]
    arrow_batches(spark, rows=16, mbytes=16)
    reaching = index.blocks.mapInArrow(partial(_reaching, sent=sent, least=least), _PAIRS)
    return top_k(_rescore(texts, reaching, sent), ["query"], order, k)


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    rows, size = [], 0
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    for key, words in queries.select(F.col(id_col), text).toLocalIterator():
        found = list(dict.fromkeys(terms(bytes(words))))
        if not found:
            continue
        if rows and (len(rows) >= QUERY_ROWS or size + len(found) > QUERY_TERMS):
            yield rows
            rows, size = [], 0
        rows.append((key, found))
        size += len(found)
    if rows:
        yield rows


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    index: Index | None = None,
) -> DataFrame:
    """The k documents with the highest scores for each query: query id, rank, id, score."""
    spark = df.sparkSession
    texts = _texts(df, id_col, text_col)
    index = index or build(df, id_col, text_col)
    key = T.StructField("item", queries.schema[query_id].dataType)
    out = None
    for rows in _query_blocks(queries, query_id, query_text) if index.docs else ():
        asked = ask(index, [q for _, q in rows])
        if not asked.terms:
            continue
        found = store(_search(index, texts, asked, k), "ranked")
        names = spark.createDataFrame(
            [(i, name) for i, (name, _) in enumerate(rows)], T.StructType([T.StructField("query", T.IntegerType()), key])
        )
        part = found.join(names, "query").select(
            F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame(
            [], T.StructType([T.StructField(query_id, key.dataType), *T._parse_datatype_string(f"rank int, {id_col} long, score long")])
        )
    return out
