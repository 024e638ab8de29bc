"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and read as words of letters, each with a blank before and after it;
its features are all n-grams of 1 to ``max_n`` characters that lie inside such a word, hashed
into ``buckets``. Training adds up, inside each task, one row of bucket counts per language;
what leaves a task is its non-zero counts, which are summed by (language, bucket). The model
is the matrix of log probabilities, ``buckets`` times the number of languages, and it travels
to the tasks as one broadcast whose size does not depend on the corpus and is checked.

Scoring is sparse: the n-grams of a batch are one long list of buckets with the bounds of the
documents, the matrix rows at those buckets are added up between the bounds, and no document
is ever a dense vector. Long texts are read in pieces, so memory is bounded.

Defined results
    * A null text, or one without a letter (Unicode), is ``und`` with score 0.
    * ``score`` is the posterior probability of the predicted language, to six places; equal
      ones give the language that comes first by its bytes.
    * Nothing but the text is read for a prediction. Rows without a language, and held-out
      rows, teach nothing; without any taught language all rows are ``und``.
    * A null identifier has no remainder, so its row is not held out.
    * Repeated rows count as often as they stand there. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import arrow_batches

BUCKET_BITS = 16
MAX_N = 4
SMOOTHING = 0.5
MODEL_BYTES = 256 << 20  # the model may not be larger; 512 languages at 16 bits
PIECE = 1 << 20  # characters that are turned into n-grams at once
UNDETERMINED = "und"

_COUNTS = "lang string, docs long, bucket int, n long"
_PREDICTED = "id long, held_out boolean, lang_pred string, score double"
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _points(text: str) -> np.ndarray:
    """The letters of a text in lower case; what is between words is one zero."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint64)


def _grams(points: np.ndarray, max_n: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the buckets of all n-grams and the places at which they begin.

    An n-gram counts if nothing but its first and last character may be a gap: it then lies
    inside one word, so no n-gram can reach from one text into the next.
    """
    filled = points > 0
    mixed = np.zeros(len(points), np.uint64)
    inside = filled
    for n in range(1, min(max_n, len(points)) + 1):
        m = len(points) - n + 1
        mixed = (mixed[:m] ^ (points[n - 1 :] + _ODD)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        if n == 1:
            ok = filled
        elif n == 2:
            ok = filled[:-1] | filled[1:]
        else:
            ok = inside = filled[1 : m + 1] if n == 3 else inside[:m] & filled[n - 2 : n - 2 + m]
        at = np.flatnonzero(ok)
        yield ((mixed[at] * _ODD) >> np.uint64(64 - bits)).astype(np.int64), at


def _pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces that end at a character that is no letter, where there is one."""
    at = 0
    while len(text) - at > size:
        cut = next((m.end() for m in re.finditer(r"[\W\d_]", text[at + size : at + 2 * size])), size)
        yield text[at : at + size + cut]
        at += size + cut
    yield text[at:]


@dataclass(frozen=True)
class Model:
    """Log probabilities as (bucket, language), and log shares of the languages."""

    langs: list[str]
    matrix: np.ndarray
    prior: np.ndarray
    max_n: int
    bits: int


def _counted(batches: Iterator[pa.RecordBatch], max_n: int, bits: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def add(lang: str) -> None:
        row = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
        for buckets, _ in _grams(np.concatenate(held.pop(lang)), max_n, bits):
            row += np.bincount(buckets, minlength=1 << bits)
        sizes[lang] = 0

    for batch in batches:
        for lang, text in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            docs[lang] = docs.get(lang, 0) + 1
            for piece in _pieces(text):
                points = _points(piece)
                held.setdefault(lang, []).append(points)
                sizes[lang] = sizes.get(lang, 0) + len(points)
                if sizes[lang] >= PIECE:
                    add(lang)
        for lang in list(held):
            add(lang)
    for lang, row in counts.items():
        used = np.flatnonzero(row)
        # the number of texts rides on a bucket of its own
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(used) + 1)),
                pa.array([docs[lang]] + [0] * len(used), pa.int64()),
                pa.array(np.concatenate([[-1], used]).astype(np.int32)),
                pa.array(np.concatenate([[0], row[used]])),
            ],
            names=["lang", "docs", "bucket", "n"],
        )


def train(
    rows: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_n: int = MAX_N,
    bits: int = BUCKET_BITS,
    smoothing: float = SMOOTHING,
) -> Model:
    """Learn from all rows that have a language and a text."""
    spark = rows.sparkSession
    taught = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    taught = taught.where("lang IS NOT NULL AND text IS NOT NULL")
    most = MODEL_BYTES // (8 << bits)
    langs = sorted((r["lang"] for r in taught.select("lang").distinct().limit(most + 1).collect()), key=str.encode)
    if len(langs) > most:
        raise ValueError(f"more than {most} languages: the model would pass {MODEL_BYTES} bytes")
    arrow_batches(spark, rows=500)
    summed = (
        taught.mapInArrow(partial(_counted, max_n=max_n, bits=bits), _COUNTS)
        .groupBy("lang", "bucket")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    )
    table = summed.toArrow()  # a row per language and bucket at most
    code = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([code[x] for x in table["lang"].to_pylist()], np.int64)
    bucket = table["bucket"].to_numpy()
    docs, n = table["docs"].to_numpy(), table["n"].to_numpy()
    counts = np.full((1 << bits, len(langs)), smoothing)
    shares = np.zeros(len(langs))
    head = bucket < 0
    shares[lang[head]] = docs[head]
    counts[bucket[~head], lang[~head]] += n[~head]
    matrix = np.log(counts) - np.log(counts.sum(axis=0))
    return Model(langs, matrix, np.log(shares / shares.sum()) if langs else shares, max_n, bits)


def _added(pieces: list[np.ndarray], owners: list[int], sums: np.ndarray, found: np.ndarray, model: Model) -> None:
    """Add the log probabilities of the pieces' n-grams to the rows of their texts."""
    ends, owner = np.cumsum([len(p) for p in pieces]), np.array(owners)
    for buckets, places in _grams(np.concatenate(pieces), model.max_n, model.bits):
        which = np.searchsorted(ends, places, side="right")
        opens = np.flatnonzero(np.diff(which, prepend=-1))
        np.add.at(sums, owner[which[opens]], np.add.reduceat(model.matrix[buckets], opens, axis=0))
        found[owner[which[opens]]] = True


def _judged(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model = sent.value
    langs = pa.array([*model.langs, UNDETERMINED], pa.string())
    for batch in batches:
        sums = np.zeros((batch.num_rows, len(model.langs)))
        found = np.zeros(batch.num_rows, bool)
        pieces: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(batch.column("text").to_pylist() if model.langs else []):
            for piece in _pieces(text or ""):
                points = _points(piece)
                if len(points) > 2:
                    pieces.append(points)
                    owners.append(i)
                    size += len(points)
                if size >= PIECE:
                    _added(pieces, owners, sums, found, model)
                    pieces, owners, size = [], [], 0
        if pieces:
            _added(pieces, owners, sums, found, model)
        logs = sums + model.prior
        best, score = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
        if found.any():
            best[found] = logs[found].argmax(axis=1)
            top = logs[found].max(axis=1, keepdims=True)
            score[found] = np.round(1 / np.exp(logs[found] - top).sum(axis=1), 6)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("held_out"), langs.take(pa.array(best)), pa.array(score)],
            names=["id", "held_out", "lang_pred", "score"],
        )


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, lang_pred, score) of rows (id, held_out, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    arrow_batches(rows.sparkSession, rows=500)
    return rows.select("id", "held_out", "text").mapInArrow(partial(_judged, sent=sent), _PREDICTED)


def held_out(id_col: str | Column = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from training, by a checksum of its identifier."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Teach on the rows that are not held out, then predict for all."""
    model = train(df.where(~held_out(id_col)), text_col, lang_col)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    return predict(rows, model).withColumnRenamed("id", id_col)
