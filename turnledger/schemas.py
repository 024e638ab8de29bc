"""Table schemas, enumerations and policy constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Enumerations of the stored tables and of the console records.
TIERS = ("bronze", "silver", "gold")
MODALITIES = ("voice", "chat")
JOURNEYS = ("order_status", "product_qa", "service_request", "escalate", "out_of_scope")
SPECIALIST_JOURNEYS = ("order_status", "product_qa", "service_request")
ROUTER_INTENTS = (
    "order_status",
    "product_qa",
    "service_request",
    "escalation",
    "out_of_scope",
)
OUTCOMES = ("contained", "escalated", "refused", "in_progress")
# The tools a live voice session can call; the last hands over to a person.
LIVE_TOOLS = (
    "lookup_recent_orders",
    "lookup_order_by_id",
    "search_knowledge_base",
    "book_service_request",
    "escalate_to_human",
)
HANDOVER_TOOL = LIVE_TOOLS[-1]
ORDER_STATUSES = ("delivered", "in_transit", "processing")
RUN_SOURCES = ("golden", "production")
SAMPLE_MODALITIES = ("voice", "chat", "all")
FAILURE_TYPES = (
    "router_misroute",
    "retrieval_miss",
    "grounding_rejection",
    "over_eager_refusal",
    "lost_context",
    "tool_error",
)
CLUSTER_ORDER = (
    "wrong_intent",
    "retrieval_miss",
    "hallucination",
    "refused_correctly",
    "refused_incorrectly",
    "incomplete",
    "other",
)
SLOT_ORDER = ("service_type", "preferred_date", "address")

# Texts and patterns that stored rows are compared with.
REFUSAL_TEXT = (
    "I don't have reliable information on that. "
    "Can I help with your order status or a product question?"
)
TRACE_ID_PATTERN = "(?i)^trc_[a-z0-9_]+$"

# Defaults applied when a stored run row or payload lacks a field.
DEFAULT_TOTAL_QUERIES = 150
DEFAULT_CONFIG_HASH = "cfg_default"
DEFAULT_ROUTER_MODEL = "gemini-2.0-flash"
DEFAULT_WRITER_MODEL = "gemini-2.0-pro"
DEFAULT_VOICE = "en-US-Neural2-F"
JOURNEY_QUERY_SHARES = {"order_status": 0.40, "product_qa": 0.35, "service_request": 0.25}
TASK_SUCCESS_SCORES = {"resolved": 1.0, "partial": 0.5, "failed": 0.0, "error": 0.0}

# US dollars per 1,000 tokens, by model class.
INPUT_PRICE_PER_1K = {"flash": 0.0003, "pro": 0.00125}
OUTPUT_PRICE_PER_1K = {"flash": 0.0025, "pro": 0.01}

# Run-level metric names and the wide column each one reads.
RUN_METRIC_COLUMNS = {
    "containment": "containment_rate",
    "refusal_precision": "refusal_precision",
    "intent_accuracy": "intent_accuracy",
    "retrieval_hit_rate_at_5": "retrieval_hit_rate",
    "hallucination_rate_post_verifier": "hallucination_rate",
    "latency_p95_ms": "latency_p95_ms",
    "cost_per_call_usd": "cost_per_call_usd",
}

# Acceptance targets (metric, journey, direction, bound).
GATE_TARGETS = (
    ("intent_accuracy", None, ">=", 0.85),
    ("retrieval_hit_rate_at_5", None, ">=", 0.80),
    ("hallucination_rate_post_verifier", None, "<=", 0.05),
    ("containment", None, ">=", 0.60),
    ("task_success", "order_status", ">=", 0.85),
    ("task_success", "product_qa", ">=", 0.70),
    ("task_success", "service_request", ">=", 0.50),
    ("latency_p95_ms", None, "<=", 4000.0),
)


@dataclass(frozen=True)
class Policy:
    """Thresholds of the turn policy; every field can be replayed at another value."""

    router_threshold: float = 0.6
    grounding_threshold: float = 0.8
    max_retries: int = 1
    hit_threshold: float = 0.5
    turn_cap: int = 12
    burst_failures: int = 3
    burst_window_seconds: int = 60
    session_ceiling_seconds: int = 600


DEFAULT_POLICY = Policy()


def struct_of(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in specs])


_S, _L, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

CONVERSATIONS = struct_of(
    ("trace_id", _S, False),
    ("modality", _S, False),
    ("customer_id", _S, True),
    ("tier", _S, True),
    ("journey", _S, False),
    ("outcome", _S, False),
    ("turns", _L, False),
    ("latency_p50_ms", _L, False),
    ("cost_usd", _D, False),
    ("created_at", _TS, False),
)

TRACE_EVENTS = struct_of(
    ("event_id", _S, False),
    ("trace_id", _S, False),
    ("event_type", _S, False),
    ("input_text", _S, True),
    ("output_text", _S, True),
    ("metadata", _S, True),
    ("latency_ms", _L, False),
    ("pii_redacted", _B, False),
    ("timestamp", _TS, False),
)

CUSTOMERS_CONTEXT = struct_of(
    ("customer_id", _S, False),
    ("tier", _S, False),
    ("lifetime_value", _D, False),
    ("open_orders", _L, False),
    ("recent_journey", _S, True),
)

ORDERS = struct_of(
    ("order_id", _S, False),
    ("customer_id", _S, False),
    ("sku", _S, False),
    ("product_name", _S, False),
    ("quantity", _L, False),
    ("status", _S, False),
    ("order_date", _TS, False),
    ("eta", _TS, True),
    ("tracking_no", _S, True),
)

EVAL_RUNS = struct_of(
    ("run_id", _S, False),
    ("git_sha", _S, False),
    ("created_at", _TS, False),
    ("source", _S, True),
    ("sample_size", _L, True),
    ("sample_modality", _S, True),
    ("refusal_precision", _D, True),
    ("intent_accuracy", _D, True),
    ("retrieval_hit_rate", _D, True),
    ("containment_rate", _D, False),
    ("task_success_order_status", _D, True),
    ("task_success_product_qa", _D, True),
    ("task_success_service_request", _D, True),
    ("hallucination_rate", _D, True),
    ("latency_p50_ms", _L, True),
    ("latency_p95_ms", _L, True),
    ("cost_per_call_usd", _D, True),
)

LABELLED_SET = struct_of(
    ("query_id", _S, False),
    ("journey", _S, False),
    ("utterance", _S, False),
    ("expected_intent", _S, False),
    ("expected_outcome", _S, False),
    ("must_contain", T.ArrayType(_S), True),
    ("must_not_contain", T.ArrayType(_S), True),
    ("requires_grounding", _B, True),
)

QUERY_RESULTS = struct_of(
    ("query_id", _S, False),
    ("journey", _S, False),
    ("utterance", _S, True),
    ("expected_intent", _S, True),
    ("expected_outcome", _S, True),
    ("response_text", _S, True),
    ("response_intent", _S, True),
    ("response_confidence", _D, True),
    ("response_grounded", _B, True),
    ("response_escalate", _B, True),
    ("derived_outcome", _S, True),
    ("latency_ms", _L, True),
    ("cost_usd", _D, True),
    ("intent_correct", _B, True),
    ("hit", _B, True),
    ("grounded", _B, True),
    ("task_success", _S, True),
    ("tone_appropriate", _S, True),
    ("hallucinated", _S, True),
    ("outcome_correct", _B, True),
    ("must_contain_ok", _B, True),
    ("must_not_contain_ok", _B, True),
    ("error", _S, True),
)

ERROR_CLUSTERS = struct_of(
    ("cluster_id", _S, False),
    ("label", _S, False),
    ("failure_type", _S, False),
    ("modality", _S, True),
    ("count", _L, False),
    ("description", _S, True),
    ("sample_trace_ids", T.ArrayType(_S), True),
)

TABLES = {
    "conversations": CONVERSATIONS,
    "conversation_traces": TRACE_EVENTS,
    "customers_context": CUSTOMERS_CONTEXT,
    "orders": ORDERS,
    "eval_runs": EVAL_RUNS,
}

# Event payloads arrive as JSON text. Numbers are read as text and cast leniently,
# so one malformed number costs one default, not the row.
PASSAGE = (
    "struct<passage_id:string,source:string,content:string,semantic_score:string,"
    "keyword_score:string,fused_score:string,rerank_score:string>"
)
PAYLOAD = {
    "reason": "string",
    "model": "string",
    "input_tokens": "string",
    "output_tokens": "string",
    "cost_usd": "string",
    "intent": "string",
    "confidence": "string",
    "threshold": "string",
    "reasoning": "string",
    "candidates": "array<struct<intent:string,score:string>>",
    "query": "string",
    "k": "string",
    "passages": f"array<{PASSAGE}>",
    "attempt": "string",
    "claims": "array<string>",
    "citations": "array<struct<passage_id:string,span:string>>",
    "verdict": "string",
    "score": "string",
    "rationale": "string",
    "ungrounded_claims": "array<struct<claim:string,reason:string>>",
    "audio_duration_ms": "string",
    "voice": "string",
    "audio_url": "string",
}

_LATEST = struct_of(
    ("modality", _S, True),
    ("customer_id", _S, True),
    ("tier", _S, True),
    ("journey", _S, True),
    ("outcome", _S, True),
    ("latency_p50_ms", _L, True),
)
# What a batch adds to the summary of a trace.
PARTIALS = struct_of(
    ("trace_id", _S, True),
    ("latest", _LATEST, True),
    ("latest_at", struct_of(("created_at", _TS, True), ("latency_p50_ms", _L, True), ("outcome", _S, True)), True),
    ("turns", _L, True),
    ("cost_micro", _L, True),
    ("created_at", _TS, True),
)
