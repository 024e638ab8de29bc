"""Quality rules by the frequency of lines across documents.

One pass over the texts gives each document its base figures and, for every normalised
line, a hash and its number of words. For each host the distinct documents that hold a line
are counted; lines in more than ``max_share`` of a host's documents, and in at least
``min_documents``, are removed, and documents that lose more than ``max_lost`` of their words
are rejected.

Copies of a document are one document here: documents are told apart by a hash of their
whole text, with A-Z in lower case and white space squeezed. Without that, a document copied
often within a host would count as boilerplate of itself. Any other difference makes another
document, however much two texts share; what they share is what is counted.

Defined results
    * A null or empty text has no words and fails the base rule.
    * A null host is a host of its own.
    * Rows are judged one by one; a row that repeats another gets the same verdict and
      counts once.
    * Lines are normalised by lower-casing A-Z and squeezing white space; lines without a
      word are ignored.
    * Other columns are not read by ``judge``; ``clean`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import arrow_batches, store, text_of

MAX_SHARE = 0.02
MIN_DOCUMENTS = 20
MAX_LOST = 0.5
LEAST_WORDS = 50

FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "text_hash long, lines array<struct<line: long, words: int>>"
)
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes) -> int:
    return np.int64(np.uint64(xxhash.xxh64_intdigest(b" ".join(line.lower().split()))).view("i8"))


def _windows(words: list[bytes]) -> np.ndarray:
    """One number for each three-word window, equal exactly for equal windows of this text."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) < 1 << 21:
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * len(known) + ids[2:]


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 3:
        return 0
    _, where, times = np.unique(_windows(words), return_inverse=True, return_counts=True)
    again = times[where] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _text_hash(text: bytes) -> int:
    """What tells documents apart: equal for texts of the same words, but for case."""
    return int(line_hash(text))


def figures(text: bytes) -> tuple:
    """The base figures of one text, the hash of its text and its lines as (hash, words)."""
    words = text.split()
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    again = 0
    for raw in text.split(b"\n"):
        n = len(raw.split())
        if n:
            again += raw in seen
            seen.add(raw)
            key = int(line_hash(raw))
            lines[key] = lines.get(key, 0) + n
    points = len(text.decode("utf-8", "surrogatepass"))
    chars = points - sum(text.count(bytes([c])) for c in WHITE)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    return len(words), chars, symbols, again, _repeated(words), _text_hash(text), lines


def _figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        rest = batch.select([n for n in batch.schema.names if n != "text"])
        texts = batch.column("text").cast(pa.binary())
        rows = [figures(t.as_py()) for t in texts]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        lines = [[{"line": k, "words": n} for k, n in d.items()] for d in cols[6]]
        made = [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(lines, line_type)]
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, *made],
            names=[
                *rest.schema.names,
                "n_words",
                "word_chars",
                "n_symbols",
                "n_dup_lines",
                "n_repeat_words",
                "text_hash",
                "lines",
            ],
        )


def measure(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """The stored figures of every row, numbered by ``row``."""
    arrow_batches(df.sparkSession)
    text = text_of(text_col)
    slim = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(host_col).cast("string").alias("host"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
    )
    head = ", ".join(f"{n} {t}" for n, t in slim.drop("text").dtypes)
    return store(slim.mapInArrow(_figures_of, f"{head}, {FIGURES}"), "figures")


def frequent_lines(
    figures: DataFrame, max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(host, line, documents) of the lines above the limits."""
    each = figures.select("host", "text_hash", F.explode("lines.line").alias("line"))
    counts = (
        each.groupBy("host", "line", "text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count("one").alias("documents"))
        .filter(F.col("documents") >= min_documents)
    )
    hosts = (
        figures.groupBy("host", "text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy(F.col("host").alias("its_host"))
        .agg(F.count("one").alias("of"))
    )
    return (
        counts.join(hosts, F.col("host").eqNullSafe(F.col("its_host")))
        .filter(F.col("documents") > max_share * F.col("of"))
        .select("host", "line", "documents")
    )


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_lost: float = MAX_LOST,
    **limits,
) -> DataFrame:
    """One row per document: its figures, the words it loses and the verdicts."""
    base = measure(df, id_col, text_col, host_col)
    bad = store(frequent_lines(base, **limits), "frequent-lines").select(
        F.col("host").alias("its_host"), F.col("line").alias("its_line")
    )
    each = base.select("row", "host", F.inline("lines"))
    lost = (
        each.join(bad, F.col("host").eqNullSafe(F.col("its_host")) & (F.col("line") == F.col("its_line")))
        .groupBy("row")
        .agg(F.sum("words").alias("n_lost_words"), F.collect_set("line").alias("lost_lines"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    )
    lost_words = F.coalesce(F.col("n_lost_words"), F.lit(0)).cast("long")
    none = F.expr("cast(array() as array<bigint>)")
    return base.join(lost, "row", "left").select(
        F.col("id").alias(id_col),
        "text_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        lost_words.alias("n_lost_words"),
        F.coalesce("lost_lines", none).alias("lost_lines"),
        failed.alias("base_failed"),
        (~failed & (lost_words <= max_lost * F.col("n_words"))).alias("kept"),
    )


def _without(names: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text_col, lost_col = names
    for batch in batches:
        at = batch.schema.names.index(text_col)
        texts, lost = batch.column(text_col).to_pylist(), batch.column(lost_col).to_pylist()
        for i, gone in enumerate(lost):
            if gone and texts[i] is not None:
                bad = set(gone)
                lines = texts[i].encode("utf-8", "surrogatepass").split(b"\n")
                kept = [x for x in lines if not x.split() or int(line_hash(x)) not in bad]
                texts[i] = b"\n".join(kept).decode("utf-8", "surrogatepass")
        batch = batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))
        yield batch.drop_columns([lost_col])


def clean(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    **limits,
) -> DataFrame:
    """The documents that are kept, without their frequent lines, with all their columns."""
    verdicts = judge(df, id_col, text_col, host_col, **limits).filter("kept")
    verdicts = verdicts.select(
        F.col(id_col).alias("__id"), F.col("text_key").alias("__its_key"), "lost_lines"
    ).withColumnRenamed("lost_lines", "__lost")
    verdicts = verdicts.groupBy("__id", "__its_key").agg(F.first("__lost").alias("__lost"))
    here = df.withColumn("__text_key", F.xxhash64(text_of(text_col)))
    met = here[id_col].eqNullSafe(verdicts["__id"]) & (here["__text_key"] == verdicts["__its_key"])
    kept = here.join(verdicts, met).select(*df.columns, "__lost")
    schema = df.schema
    names = (text_col, "__lost")
    out = kept.mapInArrow(lambda batches: _without(names, batches), schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(df.dtypes)["n_chars"]))
    return out
