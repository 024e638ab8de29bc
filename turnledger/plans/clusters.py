"""Failure analysis: first-match clusters, examples and the console readout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scoring import (
    any_hit,
    normal_outcome,
    ratio,
    routed,
    verdict_passes,
)
from turnledger.operators.ranking import top_k
from turnledger.plans.traces import parse_payload
from turnledger.schemas import CLUSTER_ORDER, DEFAULT_POLICY, FAILURE_TYPES

EXAMPLE_FIELDS = (
    "query_id",
    "utterance",
    "response_text",
    "expected_outcome",
    "derived_outcome",
    "task_success",
    "hallucinated",
    "intent_correct",
)


def _wrong(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def failures(results: DataFrame) -> DataFrame:
    """Failed rows of a labelled run with the first cluster that fits.

    Rows without labels (production) carry no verdict on intent or outcome and are
    left out: they cannot be told from wrong ones.
    """
    labelled = results.where(F.col("intent_correct").isNotNull() & F.col("outcome_correct").isNotNull())
    failed = (
        F.coalesce(F.col("task_success").isin("failed", "error", "partial"), F.lit(False))
        | F.coalesce(F.col("hallucinated") == "yes", F.lit(False))
        | _wrong("outcome_correct")
        | _wrong("intent_correct")
    )
    expected = normal_outcome(F.col("expected_outcome"))
    refused = normal_outcome(F.col("derived_outcome")) == "refused"
    cluster = (
        F.when(_wrong("intent_correct"), "wrong_intent")
        .when((F.col("journey") == "product_qa") & _wrong("hit"), "retrieval_miss")
        .when(F.col("hallucinated") == "yes", "hallucination")
        .when(refused & (expected == "refused"), "refused_correctly")
        .when(refused, "refused_incorrectly")
        .when(F.col("task_success") == "partial", "incomplete")
        .otherwise("other")
    )
    return labelled.where(failed).withColumn("cluster", cluster)


def _cluster_rank(col: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLUSTER_ORDER]), F.col(col))


def failure_clusters(results: DataFrame) -> DataFrame:
    """Count and share of failures per run and cluster, in priority order."""
    counts = failures(results).groupBy("run_id", "cluster").agg(F.count("*").alias("failures"))
    # a run has at most one row per cluster by now
    total = F.sum("failures").over(Window.partitionBy("run_id"))
    return counts.select(
        "run_id",
        "cluster",
        _cluster_rank("cluster").cast("long").alias("priority"),
        "failures",
        total.alias("total_failures"),
        ratio(F.col("failures"), total).alias("share"),
    )


def failure_examples(results: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` failed queries of every cluster, by query id, over all runs."""
    return top_k(failures(results), ["cluster"], ["query_id"], k, rank="example_rank").select(
        "cluster", "example_rank", *EXAMPLE_FIELDS
    )


def cluster_documents(results: DataFrame, k: int = 5) -> DataFrame:
    """The nested analysis row per run that the sink writes as JSON."""
    per_run = top_k(failures(results), ["run_id", "cluster"], ["query_id"], k, rank="__rank")
    examples = per_run.groupBy("run_id", "cluster").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__rank", *EXAMPLE_FIELDS))),
            lambda e: F.struct(*[e[f].alias(f) for f in EXAMPLE_FIELDS]),
        ).alias("examples")
    )
    counted = failure_clusters(results).join(examples, ["run_id", "cluster"])
    nested = counted.groupBy("run_id").agg(
        F.first("total_failures").alias("total_failures"),
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("priority", F.col("cluster").alias("name"), F.col("failures").alias("count"), "examples"))
            ),
            lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count"), c["examples"].alias("examples")),
        ).alias("clusters"),
    )
    totals = results.groupBy("run_id").agg(F.count("*").alias("total_rows"))
    return totals.join(nested, "run_id", "left").select(
        "run_id", "total_rows", F.coalesce("total_failures", F.lit(0)).alias("total_failures"), "clusters"
    )


# --- clusters derived from the traces themselves -----------------------------


def trace_failures(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """Traces with the first failure type their log shows.

    One conditional aggregation over the log, then one join on the trace id.
    """
    rows = parse_payload(
        events.where(
            F.col("event_type").isin("intent_routing", "retrieval", "grounding_verification", "escalation")
        ).select("trace_id", "event_type", "metadata"),
        "intent", "confidence", "passages", "verdict", "score", "reason",
    )
    kind = F.col("event_type")
    route = routed(F.col("p.intent"), F.col("p.confidence").try_cast("double"))
    failed_check = (kind == "grounding_verification") & ~verdict_passes(
        F.col("p.verdict"), F.col("p.score").try_cast("double")
    )
    signals = rows.groupBy("trace_id").agg(
        F.bool_or((kind == "escalation") & F.col("p.reason").isin("tool_error", "router_error")).alias("tool_error"),
        F.bool_or(
            (kind == "intent_routing") & (route["confidence"] < DEFAULT_POLICY.router_threshold)
        ).alias("low_route"),
        F.max(F.when(kind == "retrieval", any_hit(F.col("p.passages")))).alias("hit"),
        F.bool_or(failed_check).alias("rejected"),
    )
    tagged = conversations.join(signals, "trace_id", "left")
    refused = F.col("outcome") == "refused"
    failure = (
        F.when(F.coalesce("tool_error", F.lit(False)), "tool_error")
        .when(F.coalesce("low_route", F.lit(False)) & (F.col("outcome") == "escalated"), "router_misroute")
        .when(F.col("hit") == F.lit(False), "retrieval_miss")
        .when(refused & F.coalesce("hit", F.lit(False)), "over_eager_refusal")
        .when(F.coalesce("rejected", F.lit(False)), "grounding_rejection")
        .when((F.col("journey") == "service_request") & (F.col("turns") > 2) & (F.col("outcome") == "escalated"), "lost_context")
    )
    return tagged.select("trace_id", "modality", "created_at", "outcome", failure.alias("failure_type")).where(
        F.col("failure_type").isNotNull()
    )


def cluster_readout(conversations: DataFrame, events: DataFrame, scope: str = "all", samples: int = 5) -> DataFrame:
    """Console clusters: label, count, channel scope and sample traces per failure type."""
    failed = trace_failures(conversations, events)
    by_channel = failed.groupBy("failure_type", "modality").agg(F.count("*").alias("n"))
    counts = by_channel.groupBy("failure_type").agg(
        F.sum("n").alias("count"),
        F.when(F.count("*") > 1, "both").otherwise(F.min("modality")).alias("modality"),
    )
    picked = (
        top_k(failed, ["failure_type"], ["trace_id"], samples)
        .groupBy("failure_type")
        .agg(F.array_sort(F.collect_list("trace_id")).alias("sample_trace_ids"))
    )
    scope_name = F.when(F.col("modality") == "both", "voice and chat").otherwise(F.col("modality"))
    out = counts.join(picked, "failure_type").select(
        F.format_string(
            "clu_%03d",
            F.array_position(F.array(*[F.lit(t) for t in FAILURE_TYPES]), F.col("failure_type")).cast("int"),
        ).alias("cluster_id"),
        F.initcap(F.replace("failure_type", F.lit("_"), F.lit(" "))).alias("label"),
        "failure_type",
        "modality",
        "count",
        F.concat_ws(" ", "count", F.lit("conversations,"), scope_name).alias("description"),
        "sample_trace_ids",
    )
    return out if scope == "all" else out.where(F.col("modality").isin(scope, "both"))


def cluster_drill(readout: DataFrame, conversations: DataFrame) -> DataFrame:
    """The sample traces behind every cluster."""
    return (
        readout.select("cluster_id", "failure_type", F.explode("sample_trace_ids").alias("trace_id"))
        .join(conversations, "trace_id")
        .select("cluster_id", "failure_type", "trace_id", F.col("modality"), "journey", "outcome")
    )
