"""Scalar scoring rules of the evaluation and of the turn policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.functions.text import lenient_json, model_class, strip
from turnledger.schemas import (
    DEFAULT_POLICY,
    INPUT_PRICE_PER_1K,
    OUTPUT_PRICE_PER_1K,
    REFUSAL_TEXT,
    ROUTER_INTENTS,
    SPECIALIST_JOURNEYS,
    TASK_SUCCESS_SCORES,
)


def ratio(num: Column, den: Column) -> Column:
    """0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def passage_score(passage: Column) -> Column:
    """Rerank, else fused, else semantic score. A zero falls through like a missing
    one; text that is not a number ends the search and counts as no score."""

    def usable(name: str) -> Column:
        raw = passage[name]
        number = raw.try_cast("double")
        return F.when(raw.isNotNull() & (raw != "") & (number.isNull() | (number != 0)), raw)

    return F.coalesce(
        usable("rerank_score"), usable("fused_score"), usable("semantic_score"), F.lit("0")
    ).try_cast("double")


def any_hit(passages: Column, threshold: float = DEFAULT_POLICY.hit_threshold) -> Column:
    """Whether one passage reaches the threshold; null passages mean no hit."""
    return F.coalesce(F.exists(passages, lambda p: F.coalesce(passage_score(p) >= threshold, F.lit(False))), F.lit(False))


def payload_cost(cost: Column) -> Column:
    """Model cost as an exact decimal, so that sums do not depend on row order."""
    return F.coalesce(cost.try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))


def derived_outcome(text: Column, escalate: Column) -> Column:
    """The refusal text wins over the escalation flag."""
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == REFUSAL_TEXT, "refused")
        .when(F.coalesce(escalate, F.lit(False)), "escalated")
        .otherwise("contained")
    )


def normal_outcome(outcome: Column) -> Column:
    return F.lower(strip(F.coalesce(outcome, F.lit(""))))


def task_score(task_success: Column) -> Column:
    rule = F
    for label, value in TASK_SUCCESS_SCORES.items():
        rule = rule.when(task_success == label, F.lit(value))
    return rule.otherwise(F.lit(0.0))


def response_intent(intent: Column) -> Column:
    """Router intent to the console's intent label."""
    return (
        F.when(intent == "escalation", "escalate")
        .when(intent.isin(*SPECIALIST_JOURNEYS, "out_of_scope"), intent)
        .otherwise("ambiguous")
    )


def stored_journey(intent: Column) -> Column:
    """The journey written for an intent; anything that is no journey is out of scope."""
    return F.when(intent.isin(*SPECIALIST_JOURNEYS), intent).otherwise("out_of_scope")


def routed(intent: Column, confidence: Column) -> Column:
    """``struct<intent, confidence>`` after unknown intents are made out of scope with
    at most 0.4 confidence, and the confidence is held within [0, 1]."""
    known = F.coalesce(strip(intent).isin(*ROUTER_INTENTS), F.lit(False))
    conf = F.coalesce(confidence, F.lit(0.0))
    conf = F.when(known, conf).otherwise(F.least(conf, F.lit(0.4)))
    return F.struct(
        F.when(known, strip(intent)).otherwise("out_of_scope").alias("intent"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"),
    )


def verdict_passes(verdict: Column, score: Column, threshold: float | Column = DEFAULT_POLICY.grounding_threshold) -> Column:
    """A pass with a score below the threshold is still a rejection."""
    bound = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (verdict == "pass") & (F.coalesce(score, F.lit(0.0)) >= bound)


def judge_fields(text: Column) -> Column:
    """``struct<task_success, tone_appropriate, hallucinated, parsed>`` of judge output."""
    body = lenient_json(text)

    def field(name: str, default: str) -> Column:
        value = F.get_json_object(body, f"$.{name}")
        return F.lower(strip(F.coalesce(value, F.lit(default)))).alias(name)

    return F.struct(
        field("task_success", "error"),
        field("tone_appropriate", "unknown"),
        field("hallucinated", "unknown"),
        body.isNotNull().alias("parsed"),
    )


def token_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """List-price cost of a call in US dollars as an exact decimal."""
    flash = model_class(model) == "flash"

    def price(table: dict[str, float]) -> Column:
        return F.when(flash, F.lit(str(table["flash"]))).otherwise(F.lit(str(table["pro"]))).cast("decimal(8,5)")

    def part(tokens: Column, table: dict[str, float]) -> Column:
        return F.coalesce(tokens, F.lit(0)).cast("decimal(12,0)") * price(table)

    return ((part(input_tokens, INPUT_PRICE_PER_1K) + part(output_tokens, OUTPUT_PRICE_PER_1K)) / 1000).cast("decimal(18,8)")
