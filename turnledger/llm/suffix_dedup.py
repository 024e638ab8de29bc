"""Repeated 100-byte strings by deep-shallow sorting of suffixes.

A byte is removed if some string of ``depth`` bytes that covers it also starts earlier:
in a document with a smaller identifier, or earlier in the same one.

Sorting every suffix of the corpus would ship it many times over, so suffixes that cannot
repeat are left out first, without loss. Each start of a ``depth``-byte string belongs to
the least-hashed ``GRAM``-byte gram of that string; starts with the same gram make up a
unit, so units tile all starts, and equal strings belong to equal grams at equal offsets.
    * Units whose gram occurs once hold no repeated string.
    * A unit whose gram and 64-bit digest equal an earlier unit's is removed whole; its bytes
      are not compared. Whole copies and the inside of long passages go this way.
    * What is left, different units around the same gram, is sorted.
A unit is sent once, sorted by gram and digest, and judged as it streams by: of equal units
in a batch of texts only the first is sent, so a passage that stands everywhere costs one
row per batch. Texts move once, to meet their units and their spans in the same place.

The sort orders the suffixes of these units to ``depth`` bytes: multikey quicksort by
words down to ``SHALLOW`` bytes, then blind tries for the groups that still agree. A trie
node looks only at the byte where its group first differs; all tries of a task grow level
by level together. Suffixes in one leaf are equal strings, and all but the earliest go.
A gram with more than ``FULL`` different units is not gathered: its strings meet by a
128-bit hash as units of one start do, which gives the same result.

Defined results
    * A null text counts as empty; a text shorter than ``depth`` loses nothing.
    * Null identifiers come before all others; rows that share an identifier but not a text
      are two documents, ordered by start and then by a hash of the text; rows that share
      both are one document listed twice, with equal results.
    * Other columns are not read by ``report``; ``clean`` keeps them and replaces a
      character cut in half by the replacement character.
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
from turnledger.llm.first_seen import slim_documents, start_of, tag_of

DEPTH = 100
GRAM = 20
SHALLOW = 24
# Units of one gram a task gathers: some 5 MB of text and 1.5 million suffixes.
FULL = 1 << 15
PART = 1 << 22
WINDOWS_AT_ONCE = 1 << 18
JUDGED_AT_ONCE = 1 << 16
LOW = np.uint64((1 << 24) - 1)


def _words(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8-byte words that start at the n bytes from ``at`` on."""
    return np.ndarray((n,), "<u8", data.data, at, (1,))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    h = _words(data, 0, n) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += _words(data, 8, n)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += _words(data, GRAM - 8, n)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def units(data: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, gram hash) of the units of one text part."""
    h = _gram_hashes(data)
    # Order by hash, ties by place: the low bits hold the place, which is under 2**24.
    low = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    width, span = depth - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: -(width - span)], low[width - span :])
    at = (low & LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.append(first, len(at))), h[at[first]].view(np.int64)


def _text_units(text: bytes, depth: int):
    """(start, number of starts, gram hash, digest) of the units of a whole text."""
    starts, counts, keys, digests = [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for at in range(0, len(text) - depth + 1, PART):
        part = text[at : at + PART + depth - 1]
        first, count, key = units(np.frombuffer(part, np.uint8), depth)
        ends = first + count - 1 + depth
        digests += [digest(part[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
        starts.append(first + at)
        counts.append(count)
        keys.append(key)
    start, count, key = map(np.concatenate, (starts, counts, keys))
    return start, count, key, np.array(digests, np.uint64).view(np.int64)


def _rank(ids: list) -> np.ndarray:
    """Numbers in the order of the identifiers, null first."""
    null = np.array([i is None for i in ids], bool)
    number = np.array([0 if i is None else i for i in ids], np.int64)
    return np.unique(np.stack([~null, number], axis=1), axis=0, return_inverse=True)[1].reshape(-1)


def _first_of(rank: np.ndarray, where: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each kind, those that come later); a row listed again is neither."""
    by = np.lexsort((where, rank, *same))
    head = np.zeros(len(by), bool)
    head[:1] = True
    for c in same:
        head[1:] |= c[by][1:] != c[by][:-1]
    first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    later = (rank[by] != rank[first]) | (where[by] != where[first])
    return by[head], by[later]


def _units_of(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """A row per unit; a row without key for a stretch that surely goes, n then in bytes.

    Of units with the same gram and digest in a batch of texts only the first is sent on.
    """
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, t in enumerate(texts):
            text = t.as_py()
            if len(text) < depth:
                continue
            start, count, key, unit = _text_units(text, depth)
            for c, x in zip(cols, (np.full(len(start), i), key, unit, start, count), strict=True):
                c.append(x)
        if not cols[0]:
            continue
        which, key, unit, start, count = map(np.concatenate, cols)
        tag = batch.column("tag").to_numpy()
        where = (start << 31) | tag[which]
        new, again = _first_of(_rank(batch.column("id").to_pylist())[which], where, unit, key)
        new.sort()
        again.sort()
        # Neighbours that go make one stretch.
        head = np.ones(len(again), bool)
        head[1:] = (np.diff(again) > 1) | (np.diff(which[again]) > 0)
        last = again[np.append(head[1:], True)[: len(again)]]
        again = again[head]
        size = start[last] + count[last] - 1 + depth - start[again]
        gone = pa.nulls(len(again), pa.int64())
        rows = np.concatenate([new, again])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(which[rows])),
                pa.array(where[rows]),
                pa.concat_arrays([pa.array(key[new]), gone]),
                pa.array(np.concatenate([unit[new], np.zeros(len(again), np.int64)])),
                pa.array(np.concatenate([count[new], size]).astype(np.int32)),
            ],
            names=["id", "where", "key", "unit", "n"],
        )


def _judged(batches: Iterator[pa.RecordBatch], depth: int, full: int) -> Iterator[pa.RecordBatch]:
    """What goes, without key and n in bytes, and the different units of one gram.

    Rows come sorted by key, unit and order. The first rows of the units of the last key wait
    for the rows that follow, ``full`` of them at most.
    """
    # Columns: id, whether there is one, where, key, unit, n.
    wait = np.zeros((6, 0), np.int64)
    sent = 0

    def out(rows, key, n, over):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows[0], mask=rows[1] == 0),
                pa.array(rows[2]),
                key,
                pa.array(n.astype(np.int32)),
                pa.array(over),
            ],
            names=["id", "where", "key", "n", "full"],
        )

    def gone(rows, n):
        return out(rows, pa.nulls(rows.shape[1], pa.int64()), n, np.zeros(rows.shape[1], bool))

    def judge(rows, end):
        nonlocal wait, sent
        rows = np.concatenate([wait, rows], axis=1)
        if not rows.shape[1]:
            return
        number, known, where, key, unit, n = rows
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        # A row listed again is not later than itself.
        later = (known != known[first]) | (number != number[first]) | (where != where[first])
        if later.any():
            yield gone(rows[:, later], n[later] - 1 + depth)
        heads = rows[:, new]
        begin = np.flatnonzero(np.append(True, heads[3][1:] != heads[3][:-1]))
        of = np.diff(np.append(begin, heads.shape[1]))
        of[0] += sent
        ready = heads.shape[1] if end else begin[-1]
        if not end and of[-1] > full:
            ready = heads.shape[1] - 1
        each = np.repeat(of, np.diff(np.append(begin, heads.shape[1])))[:ready]
        give = heads[:, :ready][:, each > 1]
        if give.shape[1]:
            yield out(give, pa.array(give[3]), give[5], each[each > 1] > full)
        wait = heads[:, ready:]
        sent = 0 if end else of[-1] - wait.shape[1]

    held: list[np.ndarray] = []
    for batch in batches:
        key = batch.column("key")
        if key.null_count:
            sure = batch.filter(key.is_null())
            ids = sure.column("id")
            yield out(
                np.stack([ids.fill_null(0), ids.is_valid(), sure.column("where")]),
                pa.nulls(len(sure), pa.int64()),
                sure.column("n").to_numpy(),
                np.zeros(len(sure), bool),
            )
            batch = batch.filter(key.is_valid())
        ids = batch.column("id")
        cols = (ids.fill_null(0), ids.is_valid(), *(batch.column(c) for c in ("where", "key", "unit", "n")))
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols]))
        if sum(r.shape[1] for r in held) >= JUDGED_AT_ONCE:
            yield from judge(np.concatenate(held, axis=1), end=False)
            held = []
    yield from judge(np.concatenate([np.zeros((6, 0), np.int64), *held], axis=1), end=True)


# Deep-shallow sorting


def _big_endian(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers in the order of the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,))[at].astype(np.uint64)


def _ties(*sorted_cols: np.ndarray) -> np.ndarray:
    """Group numbers of a sorted sequence."""
    if not len(sorted_cols[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(sorted_cols[0]), bool)
    for c in sorted_cols:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _shared(group: np.ndarray) -> np.ndarray:
    """Which members of a sorted sequence are not alone in their group."""
    same = group[1:] == group[:-1]
    return np.append(same, False) | np.append(False, same)


def equal_strings(data: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(members, class): which of the suffixes at the given places agree to ``depth`` bytes.

    Returns indices into ``at`` of the suffixes that have an equal, class by class.
    ``data`` must hold ``depth`` bytes from each place and eight more at its end.
    """
    member = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for d in range(0, min(SHALLOW, depth - 7), 8):
        word = _big_endian(data, at[member] + d)
        by = np.lexsort((word, group))
        member, group, word = member[by], group[by], word[by]
        group = _ties(group, word)
        keep = _shared(group)
        member, group = member[keep], group[keep]
    return _blind_tries(data, at, member, group, depth)


def _blind_tries(data, at, member, group, depth):
    done_members, done_groups, classes = [], [], 0
    step = 1 << 16
    while len(member):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
        head = at[member[starts]][group]
        here = at[member]
        agree = np.full(len(member), depth, np.int64)
        offsets = np.arange(depth)
        for s in range(0, len(member), step):
            other = data[here[s : s + step, None] + offsets] != data[head[s : s + step, None] + offsets]
            some = other.any(axis=1)
            agree[s : s + step][some] = other[some].argmax(axis=1)
        branch = np.minimum.reduceat(agree, starts)
        whole = (branch >= depth)[group]
        if whole.any():
            done_members.append(member[whole])
            done_groups.append(group[whole] + classes)
            classes += len(starts)
        member, group = member[~whole], group[~whole]
        # The node's one byte: the first place where its suffixes differ.
        byte = data[at[member] + branch[group]]
        by = np.lexsort((byte, group))
        member, group, byte = member[by], group[by], byte[by]
        group = _ties(group, byte)
        keep = _shared(group) if len(group) else np.zeros(0, bool)
        member, group = member[keep], group[keep]
    if not done_members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_members), np.concatenate(done_groups)


def _later_windows(ids, where, counts, texts, depth):
    """(unit, first start, end) of runs of repeated strings in a few units."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    unit = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    member, cls = equal_strings(data, begin[unit] + offset, depth)
    if not len(member):
        return None
    u = unit[member]
    at = where[u] + (offset[member] << 31)
    by = np.lexsort((at, ids[u], cls))
    later = np.concatenate([[False], cls[by][1:] == cls[by][:-1]])
    gone = np.zeros(len(unit), bool)
    gone[member[by][later]] = True
    # Equal starts of one row listed twice never meet here: equal units are one head.
    edge = np.flatnonzero(gone)
    if not len(edge):
        return None
    first = np.concatenate([[True], (np.diff(edge) > 1) | (np.diff(unit[edge]) > 0)])
    last = np.append(first[1:], True)
    return unit[edge[first]], offset[edge[first]], offset[edge[last]] + depth


def _sorted_of(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings, from units sorted by key."""

    def out(rows):
        key, ids, where, counts, texts = rows
        found = _later_windows(_rank(ids), np.array(where, np.int64), np.array(counts, np.int64), texts, depth)
        if found is None:
            return None
        u, s, e = found
        base = np.array(where, np.int64)[u]
        start = base >> 31
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in u.tolist()], pa.int64()),
                pa.array(base & ((1 << 31) - 1), pa.int64()),
                pa.array(start + s, pa.int64()),
                pa.array(start + e, pa.int64()),
            ],
            names=["id", "tag", "start", "end"],
        )

    rows: list[list] = [[], [], [], [], []]
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("key", "id", "where", "n", "bytes")), strict=True):
            if held >= WINDOWS_AT_ONCE and row[0] != rows[0][-1]:
                made = out(rows)
                if made is not None:
                    yield made
                rows, held = [[], [], [], [], []], 0
            for c, v in zip(rows, row, strict=True):
                c.append(v)
            held += row[3]
    if held:
        made = out(rows)
        if made is not None:
            yield made


def _cut_out(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted units of each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        which, keys, wheres, counts, parts = [], [], [], [], []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text = texts[i].as_py()
            for w in wanted:
                at = w["where"] >> 31
                which.append(i)
                keys.append(w["key"])
                wheres.append(w["where"])
                counts.append(w["n"])
                parts.append(text[at : at + w["n"] - 1 + depth])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                batch.column("id").take(pa.array(which, pa.int64())),
                pa.array(wheres, pa.int64()),
                pa.array(counts, pa.int32()),
                pa.array(parts, pa.binary()),
            ],
            names=["key", "id", "where", "n", "bytes"],
        )


def _strings_of(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Every string of the units of overfull grams, as units of one start by a 128-bit hash."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        which, wheres, high, low = [], [], [], []
        for i, (where, n, text) in enumerate(
            zip(*(batch.column(k).to_pylist() for k in ("where", "n", "bytes")), strict=True)
        ):
            hashed = np.frombuffer(b"".join(digest(text[k : k + depth]) for k in range(n)), "<i8")
            which.append(np.full(n, i))
            wheres.append(where + (np.arange(n, dtype=np.int64) << 31))
            high.append(hashed[::2])
            low.append(hashed[1::2])
        if not which:
            continue
        at, where, a, b = map(np.concatenate, (which, wheres, high, low))
        new, again = _first_of(_rank(batch.column("id").to_pylist())[at], where, b, a)
        rows = np.concatenate([new, again])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(at[rows])),
                pa.array(where[rows]),
                pa.concat_arrays([pa.array(a[new]), pa.nulls(len(again), pa.int64())]),
                pa.array(b[rows]),
                pa.array(np.concatenate([np.ones(len(new)), np.full(len(again), depth)]).astype(np.int32)),
            ],
            names=["id", "where", "key", "unit", "n"],
        )


def _meet(rows: DataFrame, depth: int, full: int) -> DataFrame:
    """Equal units of all tasks, in one shuffle: see ``_judged``."""
    # Stretches that surely go only pass through; no task gets all of them.
    spread = F.coalesce("key", F.xxhash64("id", "where"))
    moved = rows.repartition(spread).sortWithinPartitions("key", "unit", "id", "where")
    return moved.mapInArrow(
        partial(_judged, depth=depth, full=full), "id long, where long, key long, n int, full boolean"
    )


def _gone(judged: DataFrame) -> DataFrame:
    return judged.filter("key is null").select(
        "id",
        tag_of("where").alias("tag"),
        start_of("where").alias("start"),
        (start_of("where") + F.col("n")).alias("end"),
    )


def _bytes_of(slim: DataFrame, open_: DataFrame, depth: int) -> DataFrame:
    """Units with their bytes. The texts are moved as in ``report``, so Spark moves them once."""
    wanted = open_.groupBy("id", tag_of("where").alias("tag")).agg(
        F.collect_list(F.struct("key", "where", "n")).alias("wanted")
    )
    theirs = wanted.select(F.col("id").alias("its_id"), F.col("tag").alias("its_tag"), "wanted")
    met = slim["id"].eqNullSafe(theirs["its_id"]) & (slim["tag"] == theirs["its_tag"])
    return slim.join(theirs, met).select("id", "text", "wanted").mapInArrow(
        partial(_cut_out, depth=depth), "key long, id long, where long, n int, bytes binary"
    )


def repeated_bytes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    full: int = FULL,
) -> DataFrame:
    """(id, tag, start, end): stretches of bytes that go, overlapping ones as they come."""
    if depth < GRAM + 8:
        raise ValueError("a string must be longer than a gram")
    arrow_batches(df.sparkSession, rows=500, mbytes=8)
    slim = slim_documents(df, id_col, text_col)
    unit_rows = "id long, where long, key long, unit long, n int"
    rows = slim.mapInArrow(partial(_units_of, depth=depth), unit_rows)
    judged = store(_meet(rows, depth, full), "units")

    cut = _bytes_of(slim, judged.filter("key is not null and not full"), depth)
    ordered = cut.repartition("key").sortWithinPartitions("key", "id", "where")
    sorted_ = ordered.mapInArrow(
        partial(_sorted_of, depth=depth), "id long, tag long, start long, end long"
    )
    # Equal strings are equal units of one start; the different ones need no further look.
    cut = _bytes_of(slim, judged.filter("key is not null and full"), depth)
    strings = cut.mapInArrow(partial(_strings_of, depth=depth), unit_rows)
    return _gone(judged).unionByName(sorted_).unionByName(_gone(_meet(strings, depth, full)))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _left(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        made = []
        for i, found in enumerate(batch.column("spans").to_pylist()):
            text, spans = texts[i].as_py(), _merged(found or [])
            kept = _left(text, spans)
            made.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*made, strict=True)) if made else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _gathered(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(its_id, its_tag, spans) of the documents that lose bytes."""
    gone = repeated_bytes(df, id_col, text_col, **how)
    return gone.groupBy(F.col("id").alias("its_id"), F.col("tag").alias("its_tag")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    theirs = _gathered(df, id_col, text_col, **how)
    slim = slim_documents(df, id_col, text_col)
    met = slim["id"].eqNullSafe(theirs["its_id"]) & (slim["tag"] == theirs["its_tag"])
    made = slim.join(theirs, met, "left").select("id", "text", "spans").mapInArrow(
        _reported, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return made.withColumnRenamed("id", id_col)


def _cleaned(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index(text_col)
        texts = batch.column(text_col).to_pylist()
        for i, found in enumerate(batch.column("__spans").to_pylist()):
            if found and texts[i] is not None:
                texts[i] = _left(texts[i].encode(), _merged(found)).decode("utf-8", "replace")
        batch = batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))
        yield batch.drop_columns(["__spans"])


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All documents without their repeated strings, with all their columns."""
    theirs = _gathered(df, id_col, text_col, **how).select(
        F.col("its_id").alias("__its_id"), F.col("its_tag").alias("__its_tag"), F.col("spans").alias("__spans")
    )
    tag = F.xxhash64(text_of(text_col)).bitwiseAND(F.lit((1 << 31) - 1))
    here = df.withColumn("__tag", tag)
    met = here[id_col].cast("long").eqNullSafe(theirs["__its_id"]) & (here["__tag"] == theirs["__its_tag"])
    joined = here.join(theirs, met, "left").select(*df.columns, "__spans")
    return joined.mapInArrow(partial(_cleaned, text_col=text_col), df.schema)
