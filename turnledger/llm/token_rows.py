"""Token ids packed into rows by best-fit decreasing.

Each task encodes its documents, cuts those longer than a row into full rows and a rest, and
packs the pieces of ``block_tokens`` tokens at a time: pieces in falling length, each into
the row with the least room that still holds it. A segment tree over the capacities
0 .. row_len finds that row: every node knows whether a row with some capacity of its range
is open. Nothing is shuffled; a row never crosses a task, and memory is bounded by the
block and the longest text.

A row holds little-endian token ids padded with ``pad_id``, the cumulative lengths of its
segments (from 0 to the number of tokens used), the position of every token in its segment
(padding has position 0), and for every segment its document and its number in it.

Defined results
    * A null or empty text has one segment of length 0, so that every document is found.
    * Segments of a document are numbered from 0 in the order of its text; joined in that
      order they are its token ids.
    * Rows that repeat an identifier are encoded as often as they stand there.
    * Strings that spell special tokens are ordinary text. Lone surrogates cannot occur in
      a Spark string. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import arrow_batches, text_of

ROW_LEN = 2048
BLOCK_TOKENS = 2_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAD_ID = 50256
CACHED = 800_000  # pieces a Python worker remembers, some 160 MB

SCHEMA = (
    "part int, row long, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, "
    "doc_ids array<long>, segments array<int>"
)


def plain_encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """The encoder of a public byte-level vocabulary of ranks."""
    import tiktoken

    # Fixed value: the published splitting pattern of this vocabulary.
    pattern = (
        r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    )
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "rows", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


# A blank between two characters that are not white always begins a new piece of the
# pattern, so what lies between two such blanks is encoded by itself and remembered.
_CUT = re.compile(r" (?<=\S )(?=\S)")


class Pieces(dict):
    """Token ids, as bytes, of a piece of text after ``before``."""

    def __init__(self, encode: Callable[[str], list[int]], before: str, dtype: str):
        super().__init__()
        self.encode, self.before, self.kind = encode, before, {"<u2": "<%dH", "<u4": "<%dI"}[dtype]
        self.marks = {mark: self._bytes(mark) for mark in ",.;:!?"}

    def _bytes(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(self.kind % len(ids), *ids)

    def __missing__(self, piece: str) -> bytes:
        # a mark after a letter or digit is a piece of the pattern by itself
        if len(piece) > 1 and piece[-1] in ",.;:!?" and piece[-2].isalnum():
            found = self[piece[:-1]] + self.marks[piece[-1]]
        else:
            found = self._bytes(self.before + piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = found
        return found


@cache
def tokenizer(vocabulary: str = VOCABULARY, dtype: str = "<u2") -> Callable[[str], np.ndarray]:
    """Text to token ids. A Python worker makes one and keeps what it has seen for its
    later tasks."""
    encode = plain_encoder(vocabulary)
    first, others = Pieces(encode, "", dtype), Pieces(encode, " ", dtype)

    def ids(text: str) -> np.ndarray:
        head, *rest = _CUT.split(text)
        return np.frombuffer(first[head] + b"".join(map(others.__getitem__, rest)), dtype)

    return ids


class Capacities:
    """Open rows by free room: the tightest that fits is found in log(row_len) steps."""

    def __init__(self, row_len: int):
        self.leaves = 1 << row_len.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(row_len + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``size``, taken out of the tree."""
        node = self.leaves + size
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.open[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], row_len: int) -> list[list[int]]:
    """Pieces per row, by best-fit decreasing; equal sizes keep their order."""
    tree, rows = Capacities(row_len), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[i])
        if found is None:
            room, row = row_len, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        tree.add(room - sizes[i], row)
    return rows


def _packed(pieces: list[tuple], part: int, first: int, row_len: int, pad_id: int, dtype) -> pa.RecordBatch:
    rows = best_fit([len(p[2]) for p in pieces], row_len)
    ids = np.full((len(rows), row_len), pad_id, dtype)
    positions = np.zeros((len(rows), row_len), "<u4" if row_len > 1 << 16 else "<u2")
    count = np.arange(row_len, dtype=positions.dtype)
    lengths, docs, segments = [], [], []
    for r, members in enumerate(rows):
        at, ends = 0, [0]
        for i in members:
            n = len(pieces[i][2])
            ids[r, at : at + n] = pieces[i][2]
            positions[r, at : at + n] = count[:n]
            at += n
            ends.append(at)
        lengths.append(ends)
        docs.append([pieces[i][0] for i in members])
        segments.append([pieces[i][1] for i in members])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(rows), pa.int32()),
            pa.array(range(first, first + len(rows)), pa.int64()),
            pa.array([x.tobytes() for x in ids], pa.binary()),
            pa.array([x[-1] for x in lengths], pa.int32()),
            pa.array(lengths, pa.list_(pa.int32())),
            pa.array([x.tobytes() for x in positions], pa.binary()),
            pa.array(docs, pa.list_(pa.int64())),
            pa.array(segments, pa.list_(pa.int32())),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def _rows_of(
    batches: Iterator[pa.RecordBatch],
    vocabulary: str,
    row_len: int,
    block_tokens: int,
    pad_id: int,
) -> Iterator[pa.RecordBatch]:
    dtype = "<u2" if pad_id < 1 << 16 else "<u4"
    encode = tokenizer(vocabulary, dtype)
    pieces: list[tuple] = []
    held = made = part = 0
    for batch in batches:
        for i, text, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids = encode(text)
            for segment, at in enumerate(range(0, max(len(ids), 1), row_len)):
                pieces.append((i, segment, ids[at : at + row_len]))
                held += min(row_len, len(ids) - at)
                if held >= block_tokens:
                    out = _packed(pieces, part, made, row_len, pad_id, dtype)
                    made += out.num_rows
                    pieces, held = [], 0
                    yield out
    if pieces:
        yield _packed(pieces, part, made, row_len, pad_id, dtype)


def token_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    row_len: int = ROW_LEN,
    block_tokens: int = BLOCK_TOKENS,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Packed rows: part, row, ids, n_tokens, cu_seqlens, positions, doc_ids, segments.

    ``vocabulary`` is read by the tasks and must lie at that path on every machine.
    """
    arrow_batches(df.sparkSession, rows=500)
    slim = df.select(
        F.col(id_col).cast("long").alias("id"),
        text_of(text_col).alias("text"),
        F.spark_partition_id().alias("part"),
    )
    pack = partial(
        _rows_of, vocabulary=vocabulary, row_len=row_len, block_tokens=block_tokens, pad_id=pad_id
    )
    return slim.mapInArrow(pack, SCHEMA)


def write_rows(rows: DataFrame, path: str) -> None:
    """The rows as files, one folder of Parquet with the ids and resets as raw matrices."""
    rows.write.mode("overwrite").parquet(path)
