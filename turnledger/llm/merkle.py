"""A Merkle manifest of a dataset, and folds that go on from stored hash states.

Rows are leaves. Those of one source, in the order of their identifiers, make a tree in which
every run of 16 nodes has one parent; the subroots, in the order of the sources, make one
more. A parent is the SHA-256 of its children's hex digests, and as a hex digest is exactly
one block of SHA-256, the state of the hash between two children is eight words. A parent
keeps a copy of that state before each child slot. To fold a changed leaf up to the root, the
state before its slot is taken up, the replacement is absorbed, then the siblings to the
right, and nothing to the left is hashed again. The digest of the proof is carried the same
way: its state goes from level to level and from job to job, so siblings are never gathered.

The first three levels are made block by block (4,096 neighbouring leaves of a source, one
exchange). The upper tree has a row per block; each of its levels is one grouping into runs
of 16, stored with its states, and its way to the root is joined to the block's rows.

Defined results
    * A null field is hashed as ``-``; any other as its length in bytes, a colon and its value.
    * Leaves with the same identifier, null first, are ordered by their digests; rows that
      are equal in every hashed field give equal rows.
    * A source of one row has its leaf as subroot; with one source the subroot is the root.
    * Null is a source of its own. An empty table has no rows and no root.
    * Only the hashed fields are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm import sha_states as sha
from turnledger.llm.common import arrow_batches, store
from turnledger.llm.numbering import in_order, numbered, part_of

FAN = 16
LEVELS = 3  # of a block
BLOCK_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 2 + 32 + FAN * 32  # bytes of a step to the root: slot, width, state, children

_LOWER = "id long, src long, block long, n long, leaf binary, top binary, fold binary, state binary, blocks long"
_PARENT = "tree long, idx long, n long, digest binary, children binary, states binary"
_FOLDED = "id long, leaf binary, subroot binary, proof binary, folded binary"


def _hashed(fields: Sequence[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    parts = [
        F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: Sequence[str] = FIELDS,
    changed: Mapping[str, Column] | None = None,
    when: Column | None = None,
) -> DataFrame:
    """(id, source, leaf, fresh): ``fresh`` is the leaf of a row with its ``changed`` fields
    where ``when`` holds, else null."""
    fresh = F.lit(None).cast("binary")
    if changed:
        fresh = F.when(when, _hashed([changed.get(f, F.col(f)) for f in fields]))
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        _hashed([F.col(f) for f in fields]).alias("leaf"),
        fresh.alias("fresh"),
    )


class Runs:
    """Parents of up to 16 nodes each, with the hash state before every child slot."""

    def __init__(self, blocks: np.ndarray, widths: np.ndarray):
        self.blocks, self.widths = blocks, widths  # (slot, word, run) and (run)

    @classmethod
    def of(cls, digests: np.ndarray, run: np.ndarray, slot: np.ndarray) -> Runs:
        """Runs of nodes, given the run and the slot of every node."""
        widths = np.bincount(run)
        blocks = np.zeros((FAN, sha.BLOCK, len(widths)), np.uint32)
        blocks[slot, :, run] = sha.hex_blocks(digests).T
        return cls(blocks, widths)

    def hash(self) -> tuple[np.ndarray, np.ndarray]:
        """The digests, and the states before each slot as (slot, word, run)."""
        state = sha.start(len(self.widths))
        states = np.zeros((FAN, sha.WORDS, len(self.widths)), np.uint32)
        for slot in range(int(self.widths.max(initial=0))):
            states[slot] = state
            live = np.flatnonzero(self.widths > slot)
            state = state.copy()
            state[:, live] = sha.absorb(state[:, live], self.blocks[slot][:, live])
        return sha.finish(state, self.widths), states

    def climb(
        self, run: np.ndarray, slot: np.ndarray, before: np.ndarray, fold: np.ndarray, proof: np.ndarray, absorbed: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One level up for many items: the folded parent, the state of the proof and the
        number of siblings in it. ``before`` is the parent's state before the item's slot.
        """
        widths = self.widths[run]
        state = sha.absorb(before, sha.hex_blocks(fold))
        # the first siblings of a proof are those to the left: the parent's own state
        proof = np.where(absorbed == 0, before, proof)
        for k in range(FAN - 1):
            left = np.flatnonzero((slot > k) & (absorbed > 0))
            if len(left):
                proof[:, left] = sha.absorb(proof[:, left], self.blocks[k][:, run[left]])
        for k in range(1, FAN):
            right = np.flatnonzero(slot + k < widths)
            if not len(right):
                break
            block = np.ascontiguousarray(self.blocks[slot[right] + k, :, run[right]].T)
            both = sha.absorb(np.hstack([state[:, right], proof[:, right]]), np.hstack([block, block]))
            state[:, right], proof[:, right] = both[:, : len(right)], both[:, len(right) :]
        return sha.finish(state, widths), proof, absorbed + widths - 1


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes of a column without nulls whose values have one width."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _binary(rows: np.ndarray, shown: np.ndarray | None = None) -> pa.Array:
    """A column of the rows of bytes, null where not ``shown``."""
    if shown is not None:
        return pa.array([r.tobytes() if s else None for r, s in zip(rows, shown, strict=True)], pa.binary())
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])


def _lower_levels(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The levels of whole blocks, whose rows follow each other."""
    src, pos, n = (batch.column(c).to_numpy() for c in ("src", "pos", "n"))
    leaf = _bytes(batch.column("leaf"), 32)
    fold = sha.words(_bytes(batch.column("fresh"), 32))
    proof, absorbed = sha.start(len(src)), np.zeros(len(src), np.int64)
    node = np.arange(len(src))
    at = {"src": src, "idx": pos, "n": n, "digest": sha.words(leaf)}
    for _ in range(LEVELS):
        grow = at["n"] > 1
        if not grow.any():
            break
        up, slot = at["idx"][grow] // FAN, at["idx"][grow] % FAN
        opens = np.ones(len(up), bool)
        opens[1:] = (np.diff(up) != 0) | (np.diff(at["src"][grow]) != 0)
        run = np.cumsum(opens) - 1
        runs = Runs.of(at["digest"][:, grow], run, slot)
        digests, states = runs.hash()
        place = np.cumsum(grow) - 1
        moves = np.flatnonzero(grow[node])
        r, s = run[place[node[moves]]], slot[place[node[moves]]]
        before = np.ascontiguousarray(states[s, :, r].T)
        fold[:, moves], proof[:, moves], absorbed[moves] = runs.climb(
            r, s, before, fold[:, moves], proof[:, moves], absorbed[moves]
        )
        stays = ~grow
        node = np.where(grow[node], stays.sum() + run[np.maximum(place[node], 0)], (np.cumsum(stays) - 1)[node])
        at = {
            "src": np.concatenate([at["src"][stays], at["src"][grow][opens]]),
            "idx": np.concatenate([at["idx"][stays], up[opens]]),
            "n": np.concatenate([at["n"][stays], -(-at["n"][grow][opens] // FAN)]),
            "digest": np.hstack([at["digest"][:, stays], digests]),
        }
    heads = pos % (1 << BLOCK_BITS) == 0
    return _batch(
        _LOWER,
        [
            batch.column("id"),
            batch.column("src"),
            pa.array(pos >> BLOCK_BITS),
            pa.array(at["n"][node]),
            batch.column("leaf"),
            _binary(sha.raw(at["digest"][:, node]), heads),
            _binary(sha.raw(fold)),
            _binary(sha.raw(proof)),
            pa.array(absorbed),
        ],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand over whole blocks: the rows of the last one wait for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        held = table.combine_chunks()
        src, block = held["src"].to_numpy(), held["pos"].to_numpy() >> BLOCK_BITS
        new = np.flatnonzero((np.diff(src) != 0) | (np.diff(block) != 0))
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield _lower_levels(held.slice(0, cut).combine_chunks().to_batches()[0])
        rest = held.slice(cut)
    if rest is not None and rest.num_rows:
        yield _lower_levels(rest.combine_chunks().to_batches()[0])


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        widths = np.diff(np.frombuffer(batch.column("children").buffers()[1], np.int32)[batch.column("children").offset :][: batch.num_rows + 1]) // 32
        run = np.repeat(np.arange(len(widths)), widths)
        slot = np.arange(len(run)) - np.repeat(np.cumsum(widths) - widths, widths)
        digests, states = Runs.of(sha.words(_bytes(batch.column("children"), 32)), run, slot).hash()
        states = np.ascontiguousarray(states.transpose(2, 0, 1)).astype(">u4").view(np.uint8).reshape(len(widths), -1)
        yield _batch(
            _PARENT,
            [batch.column(c) for c in ("tree", "idx", "n")] + [_binary(sha.raw(digests)), batch.column("children"), _binary(states)],
        )


def _to_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Climb from the blocks to the root, along the steps that a block's rows share."""
    for batch in batches:
        if not batch.num_rows:
            continue
        src, block = (batch.column(c).to_numpy() for c in ("src", "block"))
        fold, proof = (sha.words(_bytes(batch.column(c), 32)) for c in ("fold", "state"))
        absorbed = batch.column("blocks").to_numpy().copy()
        opens = np.ones(len(src), bool)
        opens[1:] = (np.diff(src) != 0) | (np.diff(block) != 0)
        way, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
        path = batch.column("path")
        offsets = np.frombuffer(path.buffers()[1], np.int32)[path.offset :][: len(src) + 1]
        data = np.frombuffer(path.buffers()[2] or b"", np.uint8)
        starts, steps = offsets[:-1][first].astype(np.int64), np.diff(offsets)[first] // STEP
        for k in range(int(steps.max(initial=0))):
            on = np.flatnonzero(steps > k)
            rows = data[(starts[on] + k * STEP)[:, None] + np.arange(STEP)]
            children = sha.words(rows[:, 34:].reshape(-1, 32))
            hexes = sha.hex_blocks(children).reshape(sha.BLOCK, len(on), FAN)
            runs = Runs(np.ascontiguousarray(hexes.transpose(2, 0, 1)), rows[:, 1].astype(np.int64))
            place = np.full(len(steps), -1)
            place[on] = np.arange(len(on))
            moves = np.flatnonzero(place[way] >= 0)
            r = place[way[moves]]
            before = np.ascontiguousarray(sha.words(rows[:, 2:34])[:, r])
            fold[:, moves], proof[:, moves], absorbed[moves] = runs.climb(
                r, rows[r, 0].astype(np.int64), before, fold[:, moves], proof[:, moves], absorbed[moves]
            )
        ended = sha.finish(proof, absorbed)
        yield _batch(
            _FOLDED,
            [batch.column(c) for c in ("id", "leaf", "subroot")] + [_binary(sha.raw(ended)), _binary(sha.raw(fold))],
        )


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def grow(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Roots and ways of trees, from nodes (tree, idx, n, digest); ``n`` is a tree's width.

    Returns (tree, digest) and, for every node, (tree, idx, path): the steps to the root,
    each with the slot, the width of the run, the state before the slot and the children.
    """
    ways = nodes.select("tree", "idx", F.col("idx").alias("at"), F.lit(bytearray()).alias("path"))
    roots = nodes.where("n = 1").select("tree", "digest")
    level = nodes.where("n > 1")
    widest = level.agg(F.max("n")).first()[0] or 1
    while widest > 1:
        child = F.struct("idx", F.hex("digest").alias("hex"))
        grouped = level.groupBy("tree", F.floor(F.col("idx") / FAN).alias("up")).agg(
            F.ceil(F.max("n") / FAN).alias("n"), F.array_sort(F.collect_list(child)).alias("c")
        )
        children = F.unhex(F.array_join(F.transform("c", lambda x: x["hex"]), ""))
        runs = grouped.select("tree", F.col("up").alias("idx"), "n", children.alias("children"))
        runs = store(runs.mapInArrow(_parents, _PARENT), name)
        slot = F.col("at") % FAN
        step = F.concat(
            _byte(slot),
            _byte(F.octet_length("children") / 32),
            F.substring(F.col("states"), (slot * 32 + 1).cast("int"), F.lit(32)),
            F.unhex(F.rpad(F.hex("children"), FAN * 64, "0")),
        )
        up = runs.select(
            F.col("tree").alias("t"), F.col("idx").alias("up"), "children", "states"
        )
        met = (F.col("tree") == F.col("t")) & (F.floor(F.col("at") / FAN) == F.col("up"))
        ways = ways.join(up, met, "left").select(
            "tree",
            "idx",
            F.floor(F.col("at") / FAN).alias("at"),
            F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path", step)).alias("path"),
        )
        roots = roots.unionByName(runs.where("n = 1").select("tree", "digest"))
        level = runs.where("n > 1").select("tree", "idx", "n", "digest")
        widest = -(-widest // FAN)
    return store(roots, f"{name}-roots"), store(ways.drop("at"), f"{name}-ways")


def manifest(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of ``leaves``: all binary digests.

    ``proof`` is the digest of the siblings from the leaf to the root, ``folded`` the root
    that follows from ``fresh`` (or the leaf, where that is null) and the original siblings.
    """
    spark = leaves.sparkSession
    kept = store(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    rows = in_order(kept, ["source", "id", "leaf", "row"], "ordered-leaves").withColumn("part", part_of())
    # where a source stands in a range partition, how many rows it has before, and in all
    pairs = rows.groupBy("part", "source").agg(F.min("seq").alias("lo"), F.count(F.lit(1)).alias("m"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = store(pairs, "parts").withColumn("before", F.coalesce(F.sum("m").over(by_part), F.lit(0)))
    sizes = store(pairs.groupBy("source").agg(F.sum("m").alias("n")), "sources")
    sources = store(numbered(sizes, ["source"], "ordered-sources", "src"), "numbered-sources")
    count = sources.count()
    named = sources.withColumnRenamed("source", "name")
    places = pairs.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("part").alias("p"), "name", "src", "n", (F.col("before") - F.col("lo")).alias("shift")
    )
    placed = rows.join(places, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("name"))).select(
        "id",
        "src",
        (F.col("seq") + F.col("shift")).alias("pos"),
        "n",
        "leaf",
        F.coalesce("fresh", "leaf").alias("fresh"),
    )
    arrow_batches(spark, rows=8192, mbytes=64)
    in_blocks = placed.repartition("src", F.shiftright("pos", BLOCK_BITS)).sortWithinPartitions("src", "pos")
    lower = store(in_blocks.mapInArrow(_blocks, _LOWER), "lower-tree")
    heads = lower.where("top IS NOT NULL").select(
        F.col("src").alias("tree"), F.col("block").alias("idx"), "n", F.col("top").alias("digest")
    )
    subroots, ways = grow(heads, "upper-tree")
    roots, source_ways = grow(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).alias("n"), "digest"),
        "source-tree",
    )
    root = roots.first()
    tops = subroots.join(source_ways.select(F.col("idx").alias("tree"), F.col("path").alias("rest")), "tree")
    tops = ways.join(tops, "tree").select(
        F.col("tree").alias("src"),
        F.col("idx").alias("block"),
        F.concat("path", "rest").alias("path"),
        F.col("digest").alias("subroot"),
    )
    arrow_batches(spark, rows=8192, mbytes=64)
    folded = lower.join(store(tops, "ways"), ["src", "block"]).mapInArrow(_to_root, _FOLDED)
    return folded.withColumn("root", F.lit(bytearray(root["digest"]) if root else bytearray()))


def verify(leaves: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest with digests in hex and whether each row still folds to the root."""
    m = manifest(leaves)
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof_sha256": "proof", "folded_root": "folded"}
    return m.select(
        F.col("id").alias(id_col),
        *[F.lower(F.hex(c)).alias(out) for out, c in names.items()],
        (F.col("folded") == F.col("root")).alias("verified"),
    )
