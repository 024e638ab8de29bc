"""Substring duplicates by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts each text where the hash falls under a
threshold, so cuts depend on nearby bytes only and an insertion moves no cut beyond the
next one. Chunks are compared by digest; of equal chunks the first by (identifier, start)
stays. Runs of neighbouring repeated chunks of at least ``min_run`` bytes are removed;
shorter ones are chance repeats and stay.

Defined results
    * A null text counts as empty: no bytes, nothing removed.
    * Rows that repeat an identifier with the same text are the same document listed twice
      and get the same result; with different texts they are two documents.
    * Null identifiers come before all others.
    * Removed runs are cut back to whole UTF-8 characters.
    * Other columns are not read by ``repeated_runs``; ``clean`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import arrow_batches, store, text_of
from turnledger.llm.first_seen import order, place, repeated, slim_documents, start_of, tag_of

MEAN_CHUNK = 40
MAX_CHUNK = 4096
MIN_RUN = 100
WINDOW = 32
# A fixed random word per byte value, from a rule rather than a table.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the sum of G[byte] shifted by its distance, mod 2**32.

    Sums over 1, 2, 4, .. bytes are doubled; after 32 bytes the shift drops a byte's word.
    """
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        shifted = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += shifted
        span *= 2
    return h


def cuts(text: bytes, mean: int = MEAN_CHUNK, longest: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of a text, ascending, the last being its length."""
    data = np.frombuffer(text, np.uint8)
    h = gear_hashes(data)
    ends = np.flatnonzero(h < np.uint32((1 << 32) // mean)) + 1
    ends = ends[(ends >= WINDOW) & (ends < len(data))]
    ends = np.append(ends, len(data))
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        # A run without a cut, such as one character over and over, is cut at its length.
        more = [np.arange(e - g, e, longest)[1:] for e, g in zip(ends, gaps, strict=True) if g > longest]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def _chunks_of(batches: Iterator[pa.RecordBatch], mean: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        which, starts, sizes, digests = [], [], [], []
        for i, t in enumerate(texts):
            text = t.as_py()
            if not text:
                continue
            ends = cuts(text, mean).tolist()
            begins = [0, *ends[:-1]]
            which.append(np.full(len(ends), i))
            starts.append(np.array(begins, np.int32))
            sizes.append(np.array(ends, np.int32) - starts[-1])
            digest = xxhash.xxh3_64_intdigest
            digests += [digest(text[s:e]) for s, e in zip(begins, ends, strict=True)]
        if not which:
            continue
        at = pa.array(np.concatenate(which))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(at),
                batch.column("tag").take(at),
                pa.array(np.array(digests, np.uint64).view(np.int64)),
                pa.array(np.concatenate(starts)),
                pa.array(np.concatenate(sizes)),
            ],
            names=["id", "tag", "digest", "start", "size"],
        )


def chunks(df: DataFrame, id_col: str, text_col: str, mean: int = MEAN_CHUNK) -> DataFrame:
    """(id, where, digest, size): a row per chunk.

    The digest joins the hash and the length of a chunk; equal texts of one identifier
    make equal rows.
    """
    arrow_batches(df.sparkSession, rows=500, mbytes=8)
    made = slim_documents(df, id_col, text_col).mapInArrow(
        partial(_chunks_of, mean=mean), "id long, tag long, digest long, start int, size int"
    )
    return made.select("id", place("start", "tag").alias("where"), "digest", "size")


def repeated_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean: int = MEAN_CHUNK,
    min_run: int = MIN_RUN,
) -> DataFrame:
    """(id, tag, runs): for each document with repeated runs, its (start, end) in bytes."""
    again = store(repeated(chunks(df, id_col, text_col, mean), "digest", "chunk-keys"), "chunks")
    # Stored, so that the join meets two plain shuffles and a hot chunk can be split.
    first = store(again.groupBy("digest", "size").agg(F.min(order()).alias("first")), "first-chunks")
    later = again.join(first, ["digest", "size"]).filter(order() != F.col("first"))
    pieces = later.groupBy("id", tag_of("where").alias("tag")).agg(
        F.sort_array(F.collect_set(F.struct(start_of("where").alias("start"), "size"))).alias("chunks")
    )
    # Neighbouring chunks become runs; a document's chunks are bounded by its text.
    made = pieces.mapInArrow(
        partial(_runs_of, min_run=min_run),
        "id long, tag long, runs array<struct<start: long, end: long>>",
    )
    return store(made, "runs")


def _runs_of(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for found in batch.column("chunks").to_pylist():
            runs: list[list[int]] = []
            for c in found:
                if runs and runs[-1][1] == c["start"]:
                    runs[-1][1] += c["size"]
                else:
                    runs.append([c["start"], c["start"] + c["size"]])
            out.append([{"start": s, "end": e} for s, e in runs if e - s >= min_run])
        keep = pa.array([bool(r) for r in out])
        made = pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tag"), pa.array(out, kind)], names=["id", "tag", "runs"]
        )
        yield made.filter(keep)


def _cut(text: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed), runs cut back to whole characters."""
    left, at, removed, count = [], 0, 0, 0
    for r in runs or ():
        s, e = r["start"], r["end"]
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            left.append(text[at:s])
            at, removed, count = e, removed + e - s, count + 1
    left.append(text[at:])
    return b"".join(left), removed, count


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        made = []
        for text, runs in zip(texts, batch.column("runs").to_pylist(), strict=True):
            kept, removed, count = _cut(text, runs)
            made.append((len(text), removed, count, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*made, strict=True)) if made else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            names=["id", "n_bytes", "n_removed", "n_runs", "kept_sha256"],
        )


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_runs, kept_sha256."""
    runs = repeated_runs(df, id_col, text_col, **how)
    return with_runs(slim_documents(df, id_col, text_col), runs).mapInArrow(
        _reported,
        "id long, n_bytes long, n_removed long, n_runs long, kept_sha256 string",
    ).withColumnRenamed("id", id_col)


def with_runs(slim: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, text, runs) of every row, runs null where nothing is removed."""
    theirs = runs.select(F.col("id").alias("its_id"), F.col("tag").alias("its_tag"), "runs")
    met = slim["id"].eqNullSafe(theirs["its_id"]) & (slim["tag"] == theirs["its_tag"])
    return slim.join(theirs, met, "left").select("id", "text", "runs")


def _cleaned(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index(text_col)
        texts = batch.column(text_col).to_pylist()
        for i, runs in enumerate(batch.column("__runs").to_pylist()):
            if runs and texts[i] is not None:
                texts[i] = _cut(texts[i].encode(), runs)[0].decode()
        batch = batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))
        yield batch.drop_columns(["__runs"])


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All documents without their repeated runs, with all their columns."""
    runs = repeated_runs(df, id_col, text_col, **how).select(
        F.col("id").alias("__its_id"), F.col("tag").alias("__its_tag"), F.col("runs").alias("__runs")
    )
    tag = F.xxhash64(text_of(text_col)).bitwiseAND(F.lit((1 << 31) - 1))
    here = df.withColumn("__tag", tag)
    met = here[id_col].cast("long").eqNullSafe(runs["__its_id"]) & (here["__tag"] == runs["__its_tag"])
    joined = here.join(runs, met, "left").select(*df.columns, "__runs")
    return joined.mapInArrow(partial(_cleaned, text_col=text_col), df.schema)
