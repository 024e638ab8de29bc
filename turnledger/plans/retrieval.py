"""Hybrid retrieval, its grading, and grounding checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.scoring import ratio
from turnledger.functions.text import claims, render, unroll, words
from turnledger.operators.joins import few
from turnledger.operators.ranking import top_k
from turnledger.plans.index import PassageIndex, best_passages, score, weighted_terms
from turnledger.schemas import DEFAULT_POLICY
from turnledger.session import stored

RRF_CONSTANT = 60
CANDIDATES = 20
ANCHOR_WORDS = 5
GRAM = 3

# How passages are shown to the writer of a reply.
CONTEXT_HEAD = "Knowledge base passages (authoritative):"
CONTEXT_LINE = "[{{NUMBER}}] source={{SOURCE}} score={{SCORE}}\n    {{PASSAGE}}"


def bm25_search(index: PassageIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best passages of every query; only blocks that can hold one are opened."""
    return best_passages(index, queries, k)


LISTS = ("bm25", "semantic")
# Scores are counted in steps of these shares before they are compared one by one.
_STEPS = {"bm25": 64, "semantic": 1024}


def _bucket(name: str) -> Column:
    return F.floor(F.col(name) * _STEPS[name]).cast("long")


def _deep_ranks(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact ranks of a few pairs, by counting the pairs before them.

    ``wanted`` is (query_id, passage_id, list, score). All pairs are counted by steps of their
    score, which combines where they lie; only those in a wanted pair's own step are
    compared with it. Nothing is put in order but the steps.
    """
    each = scored.select(
        "query_id", "passage_id", F.inline(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("score"), _bucket(n).alias("step")) for n in LISTS]))
    )
    higher = Window.partitionBy("query_id", "list").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        each.join(few(wanted.select("query_id", "list").distinct()), ["query_id", "list"], "left_semi")
        .groupBy("query_id", "list", "step")
        .agg(F.count("*").alias("n"))
        .withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    )
    step = F.coalesce(*[F.when(F.col("list") == n, F.floor(F.col("score") * _STEPS[n]).cast("long")) for n in LISTS])
    wanted = wanted.withColumn("step", step)
    mine = wanted.withColumnsRenamed({"passage_id": "id", "score": "s"})
    first = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("passage_id") < F.col("id")))
    beside = (
        each.join(few(mine), ["query_id", "list", "step"])
        .groupBy("query_id", F.col("id").alias("passage_id"), "list")
        .agg(F.count_if(first).alias("beside"))
    )
    return (
        wanted.join(steps, ["query_id", "list", "step"])
        .join(beside, ["query_id", "passage_id", "list"])
        .select("query_id", "passage_id", "list", (F.col("above") + F.col("beside") + 1).alias("rank"))
    )


def fused_ranks(scored: DataFrame, candidates: int) -> DataFrame:
    """The ``candidates`` best pairs of every query by reciprocal rank fusion of both
    lists, with their exact ranks, without putting the lists in order.

    Sorted access to the heads of both lists is enough. A pair outside both heads of depth
    ``n`` scores at most ``2 / (c + n + 1)``, and the first ``candidates`` of one list score
    more than ``1 / (c + candidates)`` each, so from ``n = c + 2 * candidates`` on no pair outside
    can be among the best. Of the pairs inside, those whose upper bound is below the
    ``candidates``-th lower bound go as well; the few others get a missing rank by counting.
    """
    depth = 2 * (RRF_CONSTANT + 2 * candidates)
    heads = [
        top_k(scored, ["query_id"], [F.desc(n), "passage_id"], depth, rank=f"{n}_rank").select(
            "*", *[F.lit(None).cast("int").alias(f"{m}_rank") for m in LISTS if m != n]
        )
        for n in LISTS
    ]
    ranks = [f"{n}_rank" for n in LISTS]
    seen = (
        heads[0]
        .unionByName(heads[1])
        .groupBy("query_id", "passage_id")
        .agg(*[F.max(n).alias(n) for n in (*LISTS, "coverage", *ranks)])
    )

    def fused(unknown: Column) -> Column:
        return sum((F.coalesce(1.0 / (RRF_CONSTANT + F.col(r)), unknown) for r in ranks), F.lit(0.0))

    by_least = Window.partitionBy("query_id").orderBy(F.desc("least"), "passage_id")
    least = seen.withColumn("least", fused(F.lit(0.0)))
    bar = F.min(F.when(F.col("place") <= candidates, F.col("least"))).over(Window.partitionBy("query_id"))
    alive = stored(
        least.withColumn("place", F.row_number().over(by_least))
        .withColumn("bar", bar)
        # scores are rounded to nine places before they are compared
        .where(fused(F.lit(1.0 / (RRF_CONSTANT + depth + 1))) + 1e-9 >= F.col("bar"))
        .drop("least", "place", "bar"),
        "alive",
    )
    missing = [
        F.when(F.col(f"{n}_rank").isNull(), F.struct(F.lit(n).alias("list"), F.col(n).alias("score"))) for n in LISTS
    ]
    wanted = alive.select("query_id", "passage_id", F.inline(F.filter(F.array(*missing), lambda m: m.isNotNull())))
    deep = _deep_ranks(scored, wanted).groupBy("query_id", "passage_id").agg(
        *[F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"deep_{n}") for n in LISTS]
    )
    known = alive.join(deep, ["query_id", "passage_id"], "left").select(
        "query_id",
        "passage_id",
        *[F.coalesce(F.col(f"{n}_rank").cast("long"), f"deep_{n}").alias(f"{n}_rank") for n in LISTS],
        "coverage",
    )
    score = F.round(sum((1.0 / (RRF_CONSTANT + F.col(r)) for r in ranks), F.lit(0.0)), 9).alias("fused_score")
    pairs = known.select("query_id", "passage_id", *ranks, score, F.col("coverage").alias("rerank_score"))
    return top_k(pairs, ["query_id"], [F.desc("fused_score"), "passage_id"], candidates, rank="fused_rank")


def hybrid_search(index: PassageIndex, queries: DataFrame, k: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """Keyword and semantic ranks fused by reciprocal rank, the head reranked.

    Every scored passage counts with its full rank in both lists; only the fused list is
    cut, to the ``candidates`` that are reranked. The rerank column is the share of the
    query's words in the passage; ``rerank_with`` swaps in a model.
    """
    scored = stored(score(index, stored(weighted_terms(index, queries), "asked")), "scored")
    head = fused_ranks(scored, candidates)
    return top_k(head, ["query_id"], [F.desc("rerank_score"), "fused_rank"], k)


def passage_context(index: PassageIndex, passages: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The numbered block of the ``k`` best passages of every query, scores to two places.

    Only the passages that are shown carry their text into the join.
    """
    found = bm25_search(index, queries, k).join(passages.select("passage_id", "source", "content"), "passage_id")
    line = render(
        CONTEXT_LINE,
        NUMBER=F.col("rank").cast("string"),
        SOURCE="source",
        SCORE=F.col("bm25").cast("decimal(18,6)").cast("decimal(18,2)").cast("string"),
        PASSAGE="content",
    )
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    block = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return found.groupBy("query_id").agg(
        F.count("*").alias("passages"), F.concat(F.lit(CONTEXT_HEAD + "\n"), block).alias("context")
    )


def rerank_with(
    head: DataFrame, passages: DataFrame, queries: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], k: int
) -> DataFrame:
    """Rerank a fused head with a model: ``fn`` scores batches of (query, content)."""
    pairs = (
        head.drop("rerank_score", "rank").join(queries, "query_id").join(passages.select("passage_id", "content"), "passage_id")
    )
    keep = [f for f in pairs.schema.fields if f.name not in ("query", "content")]
    schema = T.StructType([*keep, T.StructField("rerank_score", T.DoubleType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = fn(batch[["query", "content"]])
            yield batch[names].assign(rerank_score=pd.Series(scores).astype("float64").to_numpy())

    scored = pairs.mapInPandas(run, schema)
    return top_k(scored, ["query_id"], [F.desc("rerank_score"), "fused_rank"], k)


def _runs(words_column: Column) -> Column:
    """All distinct runs of ``ANCHOR_WORDS`` words; null when there are too few words."""
    starts = F.sequence(F.lit(1), F.size(words_column) - ANCHOR_WORDS + 1)
    cut = F.transform(starts, lambda i: F.array_join(F.slice(words_column, i, F.lit(ANCHOR_WORDS)), " "))
    return F.when(F.size(words_column) >= ANCHOR_WORDS, F.array_distinct(cut))


def _rarest(offered: DataFrame) -> DataFrame:
    """Of the anchors each text offers (query_id, anchor), the one the fewest texts share."""
    sharing = offered.groupBy("anchor").agg(F.count("*").alias("n"))
    return (
        offered.join(sharing, "anchor")
        .groupBy("query_id")
        .agg(F.min(F.struct("n", "anchor")).alias("pick"))
        .select("query_id", F.col("pick.anchor").alias("anchor"))
    )


def _grams(text: str, size: int) -> Column:
    """All distinct runs of ``size`` characters; none when the text is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut))


def _met_by_grams(passages: DataFrame, short: DataFrame) -> DataFrame:
    """Short texts meet passages on the run of characters that the fewest passages hold."""
    pairs = []
    for size in range(1, GRAM + 1):
        exact = F.length("query") == size if size < GRAM else F.length("query") >= size
        offered = short.where(exact).select("query_id", F.explode(_grams("query", size)).alias("anchor"))
        held = passages.select("passage_id", unroll(_grams("content", size)).alias("anchor")).join(
            offered.select("anchor").distinct(), "anchor", "left_semi"
        )
        spread = held.groupBy("anchor").agg(F.count("*").alias("n"))
        pick = (
            offered.join(spread, "anchor")
            .groupBy("query_id")
            .agg(F.min(F.struct("n", "anchor")).alias("pick"))
            .select("query_id", F.col("pick.anchor").alias("anchor"))
        )
        pairs.append(held.join(pick, "anchor").select("query_id", "passage_id"))
    return reduce(DataFrame.unionByName, pairs)


def planted_pairs(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs in which the passage contains the query's text verbatim.

    A passage that contains the text also contains the words inside it, one after the
    other. So both sides meet on a run of five inner words, and only the pairs that meet
    are compared in full. A text is looked up by the run it shares with the fewest other
    texts, so a common opening does not bring all texts together in one place. Texts too
    short for such a run meet on their rarest run of characters; the passages are cut
    into those only if there is such a text.
    """
    word_list = F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    sized = queries.select("query_id", "query", word_list.alias("w"))
    inner = sized.where(F.size("w") >= ANCHOR_WORDS + 2).select(
        "query_id", F.slice("w", F.lit(2), F.size("w") - 2).alias("w")
    )
    anchors = _rarest(inner.select("query_id", unroll(_runs(F.col("w"))).alias("anchor")))
    shingles = passages.select(
        "passage_id", F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")
    ).select("passage_id", unroll(_runs(F.col("w"))).alias("anchor"))
    met = shingles.join(anchors, "anchor").select("query_id", "passage_id")
    short = sized.where((F.size("w") < ANCHOR_WORDS + 2) & (F.length("query") > 0)).select("query_id", "query")
    if not short.isEmpty():
        met = met.unionByName(_met_by_grams(passages, short))
    return (
        met.join(queries, "query_id")
        .join(passages.select("passage_id", "content"), "passage_id")
        .where(F.contains("content", "query"))
        .select("query_id", "passage_id")
    )


def retrieval_quality(index: PassageIndex, passages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank and hit rates of keyword search against planted passages."""
    relevant = planted_pairs(passages, queries)
    ranked = bm25_search(index, queries, k)
    first = (
        ranked.join(relevant, ["query_id", "passage_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    )
    judged = relevant.select("query_id").distinct().join(first, "query_id", "left")
    return judged.agg(
        F.count("*").alias("queries"),
        F.round(ratio(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.count("*")), 9).alias("mrr"),
        *[ratio(F.count_if(F.col("rank") <= n), F.count("*")).alias(f"hit_at_{n}") for n in (1, 5, 10)],
    )


# --- vectors --------------------------------------------------------------------


def centroids(vectors: DataFrame, cell: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per cell. Dimensions are averaged as rows and combine map-side."""
    parts = vectors.select(cell, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(cell, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(cell).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query_vector")
    )


# --- grounding --------------------------------------------------------------------


def grounding_check(
    turns: DataFrame,
    threshold: float = DEFAULT_POLICY.grounding_threshold,
    support: float = 0.6,
    evidence: Sequence[str] = ("context",),
) -> DataFrame:
    """Share of the claims of every reply that its conversation's context supports.

    A claim is grounded when at least ``support`` of its distinct words occur in the
    context: the turns of the ``evidence`` roles, by default what was handed to the writer
    of the reply and not what the customer said. Claim words meet context words on
    (trace, word), so claims are never paired with passages. A reply without claims
    scores 1.
    """
    replies = turns.where(F.col("role") == "agent").select("trace_id", "turn", claims("text").alias("c"))
    stated = replies.select("trace_id", "turn", F.posexplode_outer("c").alias("claim_no", "claim"))
    claim_words = stated.select(
        "trace_id", "turn", "claim_no", unroll(F.array_distinct(words("claim"))).alias("word")
    ).where(F.col("word").isNotNull())
    context = (
        turns.where(F.col("role").isin(*evidence))
        .select("trace_id", unroll(F.array_distinct(words("text"))).alias("word"))
        .distinct()
        .withColumn("known", F.lit(1))
    )
    per_claim = (
        claim_words.join(context, ["trace_id", "word"], "left")
        .groupBy("trace_id", "turn", "claim_no")
        .agg((F.count("known") >= support * F.count("*")).alias("grounded"))
    )
    scores = per_claim.groupBy("trace_id", "turn").agg(F.count_if("grounded").alias("supported"))
    rows = replies.select("trace_id", "turn", F.size("c").cast("long").alias("claims")).join(
        scores, ["trace_id", "turn"], "left"
    )
    supported = F.coalesce("supported", F.lit(0))
    score = F.when(F.col("claims") == 0, F.lit(1.0)).otherwise(supported / F.col("claims"))
    return rows.select(
        "trace_id",
        "turn",
        "claims",
        supported.alias("supported"),
        score.alias("score"),
        F.when(score >= threshold, "pass").otherwise("fail").alias("verdict"),
    )
