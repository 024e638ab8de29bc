"""Exact nearest vectors over a stored index of cells and short codes.

Every vector is scaled to length one, filed under its nearest centre and kept as one signed
byte per dimension, together with the length of what the bytes leave out. Two bounds follow,
and both are safe: the angle to the centre bounds a whole cell by the triangle inequality,
and the cosine to the code, plus and minus the length left out, bounds a vector. A task keeps
a vector for a query only if its upper bound reaches the task's k-th lower bound; what all
tasks kept is cut once more by the k-th lower bound of all. Only the few that remain are
looked up in full and scored.

The centres come from a sample of bounded size; they decide how much is skipped, never what
is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.scoring import ratio
from turnledger.operators.ranking import top_k
from turnledger.operators.sampling import sample_n
from turnledger.plans.index import fingerprint
from turnledger.session import scratch, stored

FORMAT = 1
CELLS = 256
SAMPLE = 8192  # vectors that the centres are drawn from
ROUNDS = 4
QUERY_ROWS = 1024  # queries that travel to the tasks at once
SLACK = 4e-6  # single-precision sums and similarities rounded to six places

_CODES = "key long, cell int, code binary, scale float, left_out float, angle float"
_KEPT = "query int, key long, low double, high double, scored long"


@dataclass(frozen=True)
class VectorIndex:
    codes: DataFrame
    centres: np.ndarray


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical means of a sample, from its first rows on."""
    centres = sample[: max(1, min(cells, len(sample)))]
    for _ in range(ROUNDS if len(sample) else 0):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors scaled to length one. A null, one with a gap or of another width is zero."""
    rows = column.to_pylist()
    out = np.array([r if r is not None and len(r) == width and None not in r else [0.0] * width for r in rows], np.float64)
    out = out.reshape(len(rows), width)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def _encoded(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = _matrix(batch.column(1), centres.shape[1])
        scale = np.abs(unit).max(axis=1, initial=1e-30) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        left_out = np.linalg.norm(unit - code * scale.astype(np.float32)[:, None], axis=1)
        cosines = unit @ centres.T
        cell = cosines.argmax(axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
        angle[~unit.any(axis=1)] = np.pi  # its cosine to all is 0, so no cell bounds it
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(cell, pa.int32()),
                pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(scale, pa.float32()),
                pa.array(left_out, pa.float32()),
                pa.array(angle, pa.float32()),
            ],
            names=[f.split()[0] for f in _CODES.split(", ")],
        )


def write_index(vectors: DataFrame, root: str, key: str, vector: str, cells: int = CELLS) -> None:
    """Write the codes of all vectors, by cell, and last the centres."""
    spark = vectors.sparkSession
    picked = sample_n(vectors.select(key, vector), key, SAMPLE).select(vector).toArrow()[vector].combine_chunks()
    widths = [len(r) for r in picked.to_pylist() if r]
    width = max(set(widths), key=widths.count) if widths else 1
    unit = _matrix(picked, width)
    drawn = unit[unit.any(axis=1)]
    centres = _centres(drawn, cells) if len(drawn) else np.zeros((1, width))
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    codes = rows.mapInArrow(partial(_encoded, centres=centres), _CODES)
    codes.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key").write.parquet(f"{root}/codes")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table.coalesce(1).write.parquet(f"{root}/centres")


def open_index(spark: SparkSession, root: str) -> VectorIndex:
    centres = spark.read.parquet(f"{root}/centres").orderBy("cell").collect()  # CELLS rows
    return VectorIndex(spark.read.parquet(f"{root}/codes"), np.array([r["centre"] for r in centres]))


def index_of(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """The index of the vectors in a table, built once for its files as they are."""
    root = f"{scratch(spark)}/vector-index-{FORMAT}-{fingerprint(spark, path)}"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/centres/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if done is not None and len(done):
        return open_index(spark, done[0].getPath().getParent().getParent().toString())
    own = f"{root}/{uuid.uuid4().hex}"
    write_index(spark.read.parquet(path), own, key, vector)
    return open_index(spark, own)


def _kept(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """Per query, the vectors of a task that may be among the k nearest of all."""
    asked, centres = sent.value
    to_centres = np.arccos(np.clip(asked @ centres.T, -1, 1))
    wide = asked.astype(np.float32)
    lows = np.full((len(asked), k), -np.inf)
    bar = np.full(len(asked), -np.inf)
    kept: list[tuple[np.ndarray, ...]] = []
    scored = 0
    for batch in batches:
        column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "cell", "scale", "left_out", "angle")}
        # a cell's nearest possible cosine
        near = np.maximum(0, to_centres[:, column["cell"]] - column["angle"][None] - 1e-6)
        open_ = np.cos(near) + SLACK >= bar[:, None]
        some = np.flatnonzero(open_.any(axis=0))
        if not len(some):
            continue
        code = np.frombuffer(b"".join(batch.column("code").take(pa.array(some)).to_pylist()), np.int8).reshape(len(some), -1)
        scored += len(some)
        cosines = (wide @ code.T.astype(np.float32)).astype(np.float64) * column["scale"][some][None]
        margin = column["left_out"][some][None] + SLACK
        low, high = cosines - margin, cosines + margin
        both = np.hstack([lows, np.where(open_[:, some], low, -np.inf)])
        lows = -np.partition(-both, k - 1, axis=1)[:, :k]
        bar = lows.min(axis=1)
        query, at = np.nonzero(open_[:, some] & (high >= bar[:, None]))
        kept.append((query, column["key"][some][at], low[query, at], high[query, at]))
    if kept:
        query, key, low, high = (np.concatenate([p[i] for p in kept]) for i in range(4))
        here = high >= bar[query]
        first = np.zeros(int(here.sum()), np.int64)
        first[:1] = scored
        yield pa.RecordBatch.from_arrays(
            [pa.array(query[here], pa.int32()), pa.array(key[here]), pa.array(low[here]), pa.array(high[here]), pa.array(first)],
            names=[f.split()[0] for f in _KEPT.split(", ")],
        )


def dot(a, b):
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def candidates(index: VectorIndex, queries: list[list[float]], k: int) -> DataFrame:
    """(query, key): all that can be among the k nearest of a query of the block."""
    spark = index.codes.sparkSession
    width = index.centres.shape[1]
    asked = _matrix(pa.array(queries, pa.list_(pa.float64())), width)
    sent = spark.sparkContext.broadcast((asked, index.centres))
    kept = stored(index.codes.mapInArrow(partial(_kept, sent=sent, k=k), _KEPT), "kept-vectors")
    least = top_k(kept, ["query"], [F.desc("low"), "key"], k).where(F.col("rank") == k).select("query", F.col("low").alias("bar"))
    return kept.join(least, "query", "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("query", "key")


def _blocks(queries: DataFrame, size: int = QUERY_ROWS) -> Iterator[list]:
    rows: list = []
    for row in queries.select("query_id", "query_vector").toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def vector_search(
    index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest vectors of all by cosine to each query, exactly.

    ``queries`` is a stated set of ``(query_id, query_vector)`` and is taken in blocks, so its
    size is not bounded. A zero vector, a null, and one with a gap or of another width have
    similarity 0.
    """
    spark = vectors.sparkSession
    full = vectors.select(F.col(key).alias("__key"), F.col(vector).alias("v"))
    out = None
    for rows in _blocks(queries):
        named = spark.createDataFrame(
            [(i, r["query_id"], r["query_vector"]) for i, r in enumerate(rows)],
            T.StructType([T.StructField("query", T.IntegerType()), queries.schema["query_id"], queries.schema["query_vector"]]),
        )
        near = candidates(index, [r["query_vector"] for r in rows], k)
        met = near.join(full, near["key"] == full["__key"]).join(named, "query")
        v, q = F.col("v"), F.col("query_vector")
        cosine = ratio(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
        part = met.select("query_id", F.col("__key").alias(key), F.round(cosine, 6).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = T.StructType([queries.schema["query_id"], vectors.schema[key], T.StructField("similarity", T.DoubleType())])
        out = spark.createDataFrame([], kinds)
    return top_k(out, ["query_id"], [F.desc("similarity"), key], k)
