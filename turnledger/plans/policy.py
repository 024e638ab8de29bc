"""Turn policy on recorded traces: replay, verifier rates and failure bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scoring import (
    payload_cost,
    ratio,
    response_intent,
    routed,
    stored_journey,
    token_cost,
    verdict_passes,
)
from turnledger.operators.ordered import time_slice
from turnledger.plans.traces import parse_payload
from turnledger.schemas import DEFAULT_POLICY, Policy


def policy_inputs(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """What the policy decides on, one row per trace: normalised routing, both verdicts."""
    kinds = ("intent_routing", "grounding_verification", "escalation")
    rows = parse_payload(
        events.where(F.col("event_type").isin(*kinds)).select("trace_id", "event_type", "event_id", "timestamp", "metadata"),
        "intent", "confidence", "attempt", "verdict", "score", "reason",
    )
    at = F.struct("timestamp", "event_id")
    kind = F.col("event_type")
    attempt = F.coalesce(F.col("p.attempt").try_cast("int"), F.lit(1))
    check = F.struct(F.col("p.verdict").alias("verdict"), F.col("p.score").try_cast("double").alias("score"))
    signals = rows.groupBy("trace_id").agg(
        F.max_by(
            routed(F.col("p.intent"), F.col("p.confidence").try_cast("double")),
            F.when(kind == "intent_routing", at),
        ).alias("route"),
        F.max_by(check, F.when((kind == "grounding_verification") & (attempt == 1), at)).alias("first_check"),
        F.max_by(check, F.when((kind == "grounding_verification") & (attempt == 2), at)).alias("second_check"),
        F.bool_or((kind == "escalation") & (F.col("p.reason") == "tool_error")).alias("tool_error"),
    )
    return conversations.select("trace_id", "turns", "outcome", "journey").join(signals, "trace_id", "left")


def decide(inputs: DataFrame, policy: Policy | Column = DEFAULT_POLICY) -> DataFrame:
    """Run the gate cascade: router error, confidence, hand-off request, scope, turn
    cap, tool error, then verification with at most one retry before refusing.

    ``policy`` may be a struct column, so one pass can decide under many policies.
    """

    def bound(name: str) -> Column:
        return policy[name] if isinstance(policy, Column) else F.lit(getattr(policy, name))

    route = F.col("route")
    grounding = bound("grounding_threshold")

    def passes(check: str) -> Column:
        return F.coalesce(verdict_passes(F.col(f"{check}.verdict"), F.col(f"{check}.score"), grounding), F.lit(False))

    retried = (bound("max_retries") >= 1) & passes("second_check")
    reason = (
        F.when(F.col("route").isNull(), "router_error")
        .when(route["confidence"] < bound("router_threshold"), "low_confidence")
        .when(route["intent"] == "escalation", "explicit_request")
        .when(route["intent"] == "out_of_scope", F.lit(None))
        .when(F.col("turns") > bound("turn_cap"), "turn_cap")
        .when(F.coalesce("tool_error", F.lit(False)), "tool_error")
        .when(passes("first_check") | retried, F.lit(None))
        .otherwise("grounding_failed")
    )
    refused = (reason == "grounding_failed") | (reason.isNull() & (route["intent"] == "out_of_scope"))
    intent = F.when(F.col("route").isNull(), "ambiguous").when(reason == "explicit_request", "escalate").otherwise(
        response_intent(route["intent"])
    )
    return inputs.select(
        "*",
        reason.alias("reason"),
        intent.alias("response_intent"),
        stored_journey(intent).alias("replayed_journey"),
        F.when(F.coalesce(refused, F.lit(False)), "refused")
        .when(reason.isNotNull(), "escalated")
        .otherwise("contained")
        .alias("replayed_outcome"),
    )


def policy_replay(conversations: DataFrame, events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return decide(policy_inputs(conversations, events), policy).select(
        "trace_id",
        "outcome",
        "replayed_outcome",
        F.coalesce("reason", F.lit("none")).alias("reason"),
        "response_intent",
        "replayed_journey",
    )


def policy_sweep(
    conversations: DataFrame,
    events: DataFrame,
    router_thresholds: Sequence[float] = (0.5, 0.6, 0.7, 0.8),
    grounding_thresholds: Sequence[float] = (0.7, 0.8, 0.95),
) -> DataFrame:
    """Outcome shares under every pair of thresholds.

    The short list of policies is a literal array unrolled inside the scan stage and
    summed up map-side; nothing is joined.
    """
    grid = [
        F.struct(
            F.lit(float(r)).alias("router_threshold"),
            F.lit(float(g)).alias("grounding_threshold"),
            F.lit(DEFAULT_POLICY.max_retries).alias("max_retries"),
            F.lit(DEFAULT_POLICY.turn_cap).alias("turn_cap"),
        )
        for r in router_thresholds
        for g in grounding_thresholds
    ]
    rows = policy_inputs(conversations, events).withColumn("policy", F.explode(F.array(*grid)))
    decided = decide(rows, F.col("policy"))
    return decided.groupBy(
        F.col("policy.router_threshold").alias("router_threshold"),
        F.col("policy.grounding_threshold").alias("grounding_threshold"),
    ).agg(
        F.count("*").alias("traces"),
        *[
            ratio(F.count_if(F.col("replayed_outcome") == o), F.count("*")).alias(f"{o}_rate")
            for o in ("contained", "escalated", "refused")
        ],
    )


def verifier_rates(events: DataFrame) -> DataFrame:
    """Rejections per attempt; a rejected first attempt is what the customer would
    have been told without the verifier."""
    rows = parse_payload(events.where(F.col("event_type") == "grounding_verification"), "attempt", "verdict", "score")
    attempt = F.coalesce(F.col("p.attempt").try_cast("int"), F.lit(1)).cast("long").alias("attempt")
    score = F.col("p.score").try_cast("double")
    rejected = ~F.coalesce(verdict_passes(F.col("p.verdict"), score), F.lit(False))
    return rows.groupBy(attempt).agg(
        F.count("*").alias("checks"),
        F.count_if(rejected).alias("rejections"),
        ratio(F.count_if(rejected), F.count("*")).alias("rejection_rate"),
        F.count_if(rejected & (F.col("p.verdict") == "pass")).alias("overridden"),
    )


def escalation_reasons(events: DataFrame, conversations: DataFrame) -> DataFrame:
    """Reason counts, their share of escalations and of all conversations."""
    rows = events.where(F.col("event_type") == "escalation")
    reasons = (
        rows.groupBy(F.coalesce(F.get_json_object("metadata", "$.reason"), F.lit("unknown")).alias("reason"))
        .agg(F.count("*").alias("escalations"))
    )
    escalated = rows.agg(F.count("*")).scalar()  # reasons are free text: no bound on their number
    everyone = conversations.agg(F.count("*")).scalar()
    return reasons.select(
        "reason",
        "escalations",
        ratio(F.col("escalations"), escalated).alias("share"),
        ratio(F.col("escalations"), everyone).alias("rate"),
    )


def failure_bursts(signals: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Moments at which a service has failed too often in the trailing window.

    ``signals`` has service, event_id, timestamp and failed; a success clears the
    history. Each event is also handed to the next time slice as context, so a
    service-and-slice group holds everything its own events need to look back at and
    a busy service spreads over its slices.
    """
    width = policy.burst_window_seconds
    own = time_slice("timestamp", width)
    rows = signals.select(
        "service",
        "event_id",
        "timestamp",
        "failed",
        F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own")))).alias("s"),
    ).select("service", "event_id", "timestamp", "failed", "s.*")
    order = ["timestamp", "event_id"]
    group = Window.partitionBy("service", "slice")
    rows = rows.withColumn(
        "era", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    )
    trailing = (
        Window.partitionBy("service", "slice", "era")
        .orderBy(F.unix_micros("timestamp"))
        .rangeBetween(-width * 1_000_000, 0)
    )
    counted = rows.withColumn("recent", F.sum(F.col("failed").cast("long")).over(trailing))
    return counted.where(F.col("own") & F.col("failed") & (F.col("recent") >= policy.burst_failures)).select(
        "service", "event_id", "timestamp", F.col("recent").alias("failures_in_window")
    )


def cost_ledger(events: DataFrame) -> DataFrame:
    """Calls, tokens, recorded and list-price cost per model and stage."""
    stages = events.where(F.col("event_type").isin("intent_routing", "synthesis", "grounding_verification"))
    rows = parse_payload(stages, "model", "input_tokens", "output_tokens", "cost_usd")
    tokens_in = F.col("p.input_tokens").try_cast("long")
    tokens_out = F.col("p.output_tokens").try_cast("long")
    model = F.coalesce("p.model", F.lit("unknown"))
    return rows.groupBy(model.alias("model"), F.col("event_type").alias("stage")).agg(
        F.count("*").alias("calls"),
        F.sum(tokens_in).alias("input_tokens"),
        F.sum(tokens_out).alias("output_tokens"),
        F.sum(payload_cost(F.col("p.cost_usd"))).cast("double").alias("recorded_cost_usd"),
        F.sum(token_cost(model, tokens_in, tokens_out)).cast("double").alias("list_cost_usd"),
    )
