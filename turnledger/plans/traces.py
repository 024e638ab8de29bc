"""Trace tables: summaries, typed events, documents, timelines and contract checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.scoring import any_hit, payload_cost
from turnledger.functions.text import iso_millis
from turnledger.operators import ordered
from turnledger.schemas import (
    DEFAULT_POLICY,
    DEFAULT_ROUTER_MODEL,
    DEFAULT_VOICE,
    DEFAULT_WRITER_MODEL,
    JOURNEYS,
    MODALITIES,
    OUTCOMES,
    PAYLOAD,
    TIERS,
    TRACE_ID_PATTERN,
)

SLICE_SECONDS = 60


def customer_label(customer_id: str = "customer_id", tier: str = "tier") -> Column:
    """Null when either part is null."""
    return F.concat(F.lit("Cust #"), F.col(customer_id), F.lit(" · "), F.initcap(F.col(tier)))


def collapse_summaries(log: DataFrame) -> DataFrame:
    """One row per trace from a summary log that may hold a row per turn.

    Turns and cost add up, the first row gives the start, the latest row the rest.
    All aggregates combine map-side, so a trace with many rows costs no extra.
    """
    latest = F.struct("created_at", "latency_p50_ms", "outcome")
    return (
        log.groupBy("trace_id")
        .agg(
            F.max_by(
                F.struct("modality", "customer_id", "tier", "journey", "outcome", "latency_p50_ms"), latest
            ).alias("l"),
            F.sum("turns").alias("turns"),
            F.sum("cost_micro").alias("cost_micro"),
            F.min("created_at").alias("created_at"),
        )
        .select("trace_id", "l.*", "turns", "cost_micro", "created_at")
    )


def trace_list(
    conversations: DataFrame, modality: str = "all", since: datetime | None = None, limit: int | None = 200
) -> DataFrame:
    """Newest conversations first, as the console lists them."""
    rows = conversations
    if modality != "all":
        rows = rows.where(F.col("modality") == modality)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since))
    rows = rows.orderBy(F.desc("created_at"), "trace_id").limit(limit or 200)
    return rows.select(
        "trace_id",
        iso_millis("created_at").alias("started_at"),
        "modality",
        customer_label().alias("customer_label"),
        F.col("journey").alias("intent"),
        "journey",
        "outcome",
        F.col("turns").alias("turn_count"),
        F.col("latency_p50_ms").alias("total_latency_ms"),
        F.col("cost_usd").alias("total_cost_usd"),
    )


def parse_payload(events: DataFrame, *fields: str) -> DataFrame:
    """Parse the payload text once per row into the struct column ``p``.

    Naming the fields a job needs keeps the parser from building the others.
    """
    schema = ", ".join(f"{name} {PAYLOAD[name]}" for name in fields or PAYLOAD)
    return events.withColumn("p", F.from_json("metadata", schema, {"mode": "PERMISSIVE"}))


def _num(name: str, default: float) -> Column:
    return F.coalesce(F.col(f"p.{name}").try_cast("double"), F.lit(float(default)))


def _int(name: str, default: int | Column) -> Column:
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.col(f"p.{name}").try_cast("double").cast("long"), default.cast("long"))


def _text(name: str, default: str) -> Column:
    return F.coalesce(F.col(f"p.{name}"), F.lit(default))


# Stored event kinds and the kind each is shown as.
EVENT_KINDS = {
    "user_message": "user_message",
    "stt": "stt",
    "intent_routing": "router",
    "retrieval": "retrieval",
    "synthesis": "synthesis",
    "grounding_verification": "verification",
    "tts": "tts",
    "agent_response": "agent_response",
}
# Kinds the full view keeps under their own name.
EXTRA_KINDS = (
    "escalation",
    "order_lookup",
    "slot_extraction",
    "live_session_open",
    "live_user_transcript",
    "live_assistant_text",
    "live_interruption",
    "live_tool_call",
    "live_session_close",
)


def shown_events(events: DataFrame, full: bool = False) -> DataFrame:
    """Rows a reader shows: known kinds, stages not skipped."""
    kept = list(EVENT_KINDS) + (list(EXTRA_KINDS) if full else [])
    # the plain text test spares most rows a JSON parse
    skipped = F.contains("metadata", F.lit('"skipped"')) & (F.get_json_object("metadata", "$.skipped") == "true")
    return events.where(F.col("event_type").isin(kept) & ~F.coalesce(skipped, F.lit(False)))


def shown_kind() -> Column:
    kind = F.col("event_type")
    for stored, shown in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == stored, shown).otherwise(kind)
    return kind


def typed_events(events: DataFrame, full: bool = False) -> DataFrame:
    """Stored rows as typed events: a tagged union with one nullable struct per kind.

    Skipped stages and unknown kinds are dropped. ``full`` also keeps the escalation,
    lookup, slot and live kinds that the console's reader leaves out.
    """
    rows = parse_payload(shown_events(events, full))
    kind = shown_kind()
    is_kind = {shown: F.col("event_type") == stored for stored, shown in EVENT_KINDS.items()}
    passages = F.coalesce("p.passages", F.array().cast(PAYLOAD["passages"]))
    reply = F.coalesce("output_text", F.lit(""))
    heard = F.coalesce("input_text", F.lit(""))
    payload = {
        "user_message": F.struct(heard.alias("text"), "pii_redacted"),
        "stt": F.struct(
            _int("audio_duration_ms", 0).alias("audio_duration_ms"),
            reply.alias("transcript"),
            _num("confidence", 0).alias("confidence"),
            "pii_redacted",
        ),
        "router": F.struct(
            _text("model", DEFAULT_ROUTER_MODEL).alias("model"),
            _text("intent", "ambiguous").alias("intent"),
            _num("confidence", 0).alias("confidence"),
            _num("threshold", 0.7).alias("threshold"),
            _text("reasoning", "").alias("reasoning"),
            F.transform(
                "p.candidates",
                lambda c: F.struct(c["intent"].alias("intent"), c["score"].try_cast("double").alias("score")),
            ).alias("candidates"),
        ),
        "retrieval": F.struct(
            _text("query", "").alias("query"),
            _int("k", F.size(passages)).alias("k"),
            passages.alias("passages"),
        ),
        "synthesis": F.struct(
            _text("model", DEFAULT_WRITER_MODEL).alias("model"),
            _int("attempt", 1).alias("attempt"),
            reply.alias("response_text"),
            F.col("p.citations").alias("citations"),
        ),
        "verification": F.struct(
            _text("model", DEFAULT_WRITER_MODEL).alias("model"),
            _int("attempt", 1).alias("attempt"),
            _text("verdict", "pass").alias("verdict"),
            _num("score", 0).alias("score"),
            _num("threshold", 0.8).alias("threshold"),
            _text("rationale", "").alias("rationale"),
            F.col("p.ungrounded_claims").alias("ungrounded_claims"),
        ),
        "tts": F.struct(
            _text("voice", DEFAULT_VOICE).alias("voice"),
            _int("audio_duration_ms", 0).alias("audio_duration_ms"),
            _text("audio_url", "").alias("audio_url"),
        ),
        "agent_response": F.struct(reply.alias("text"), F.col("p.audio_url").alias("audio_url")),
    }
    return rows.select(
        "event_id",
        "trace_id",
        kind.alias("event_type"),
        F.lit(0).alias("turn_index"),
        F.col("timestamp"),
        "latency_ms",
        _int("input_tokens", 0).alias("llm_input_tokens"),
        _int("output_tokens", 0).alias("llm_output_tokens"),
        payload_cost(F.col("p.cost_usd")).cast("double").alias("llm_cost_usd"),
        *[F.when(is_kind[k], v).alias(k) for k, v in payload.items()],
    )


def event_report(typed: DataFrame) -> DataFrame:
    """Flat event rows with the headline flags of the drill-down view."""
    return typed.select(
        "event_id",
        "trace_id",
        "event_type",
        iso_millis("timestamp").alias("timestamp"),
        "latency_ms",
        "llm_input_tokens",
        "llm_output_tokens",
        "llm_cost_usd",
        F.coalesce("user_message.text", "stt.transcript", "synthesis.response_text", "agent_response.text").alias("text"),
        F.coalesce("router.model", "synthesis.model", "verification.model").alias("model"),
        F.coalesce("router.confidence", "stt.confidence").alias("confidence"),
        F.col("router.intent").alias("intent"),
        F.size("router.candidates").alias("candidate_count"),
        F.coalesce("synthesis.attempt", "verification.attempt").alias("attempt"),
        F.col("verification.verdict").alias("verdict"),
        F.col("verification.score").alias("score"),
        F.col("retrieval.k").alias("k"),
        F.size("retrieval.passages").alias("passage_count"),
        (F.col("router.confidence") < F.col("router.threshold")).alias("below_threshold"),
        (F.col("verification.attempt") > 1).alias("is_retry"),
        F.when(F.col("retrieval").isNotNull(), any_hit(F.col("retrieval.passages"))).alias("hit"),
    )


def trace_documents(conversations: DataFrame, events: DataFrame, page_size: int = 500) -> DataFrame:
    """Summary plus time-ordered events, nested, in pages of ``page_size`` events.

    A page bounds the array, so one endless trace becomes many rows, not one huge one.
    The totals of a trace ride on the rows that carry positions from slice to slice, so the
    log is read for nothing else and a trace's pages never meet in one task.
    """
    shown = shown_events(events).select(
        "trace_id", "event_id", shown_kind().alias("event_type"), "timestamp"
    )
    numbered = ordered.running_sums(
        shown,
        ["trace_id"],
        ordered.time_slice("timestamp", SLICE_SECONDS),
        ["timestamp", "event_id"],
        {"position": F.lit(1).cast("long")},
        whole_sum={"event_count": "position"},
        whole_max={"last_at": "timestamp"},
    )
    pages = numbered.groupBy(
        "trace_id", F.floor((F.col("position") - 1) / page_size).cast("long").alias("page")
    ).agg(
        F.array_sort(F.collect_list(F.struct("position", "event_id", "event_type", "timestamp"))).alias("events"),
        F.max("event_count").alias("event_count"),
        F.max("last_at").alias("last_at"),
    )
    return conversations.join(pages, "trace_id", "left").select(
        "trace_id",
        "modality",
        customer_label().alias("customer_label"),
        "outcome",
        iso_millis("created_at").alias("started_at"),
        iso_millis(F.coalesce("last_at", "created_at")).alias("ended_at"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce(
            "events",
            F.array().cast("array<struct<position:bigint,event_id:string,event_type:string,timestamp:timestamp>>"),
        ).alias("events"),
    )


def trace_document(conversations: DataFrame, events: DataFrame, trace_id: str, page_size: int = 500) -> DataFrame:
    """One trace; the predicate reaches both scans."""
    same = F.col("trace_id") == trace_id
    return trace_documents(conversations.where(same), events.where(same), page_size)


def trace_timeline(events: DataFrame) -> DataFrame:
    """Every stage with its offset in the trace and the gap to the stage before."""
    rows = events.select("trace_id", "event_id", "event_type", "timestamp", "latency_ms")
    gaps = ordered.lag(
        rows,
        ["trace_id"],
        ordered.time_slice("timestamp", SLICE_SECONDS),
        ["timestamp", "event_id"],
        {"previous_at": "timestamp"},
        {"first_at": "timestamp"},
    )
    micros = F.unix_micros("timestamp")
    return gaps.select(
        "trace_id",
        "event_id",
        "event_type",
        "latency_ms",
        F.floor((micros - F.unix_micros("first_at")) / 1000).alias("offset_ms"),
        F.floor((micros - F.unix_micros("previous_at")) / 1000).alias("gap_ms"),
    )


def trace_costs(events: DataFrame) -> DataFrame:
    """Model cost per trace; payload costs that are no numbers are skipped."""
    cost = F.get_json_object("metadata", "$.cost_usd")
    return events.groupBy("trace_id").agg(
        F.sum(payload_cost(cost)).alias("cost_usd"),
        F.count(cost.try_cast("double")).alias("costed_events"),
    )


def retrieval_hits(events: DataFrame, threshold: float = DEFAULT_POLICY.hit_threshold) -> DataFrame:
    """Traces that ran retrieval and whether one passage was good enough."""
    rows = parse_payload(events.where(F.col("event_type") == "retrieval"), "passages")
    return rows.groupBy("trace_id").agg(
        F.max(any_hit(F.col("p.passages"), threshold)).alias("hit"),
        F.count("*").alias("retrievals"),
    )


def conversation_rules() -> dict[str, Column]:
    return {
        "trace_id_pattern": ~F.coalesce(F.col("trace_id").rlike(TRACE_ID_PATTERN), F.lit(False)),
        "modality_enum": ~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)),
        "journey_enum": ~F.coalesce(F.col("journey").isin(*JOURNEYS), F.lit(False)),
        "outcome_enum": ~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)),
        "tier_enum": F.col("tier").isNotNull() & ~F.col("tier").isin(*TIERS),
        "anonymous_without_tier": F.col("customer_id").isNull() != F.col("tier").isNull(),
        "turns_positive": F.coalesce(F.col("turns") < 1, F.lit(True)),
        "latency_positive": F.coalesce(F.col("latency_p50_ms") <= 0, F.lit(True)),
    }


def event_rules() -> dict[str, Column]:
    return {
        "trace_id_pattern": ~F.coalesce(F.col("trace_id").rlike(TRACE_ID_PATTERN), F.lit(False)),
        "event_type_enum": ~F.coalesce(F.col("event_type").isin(*EVENT_KINDS, *EXTRA_KINDS), F.lit(False)),
        "metadata_json": F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(),
        "blank_user_message": (F.col("event_type") == "user_message")
        & (F.length(F.trim(F.coalesce("input_text", F.lit("")))) == 0),
    }


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break in ``violations``."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def quarantined_events(events: DataFrame) -> DataFrame:
    """The log rows that break a rule, with the rules they break."""
    return quarantine(events, event_rules()).select(
        "event_id", "trace_id", "event_type", F.array_join("violations", ",").alias("violations")
    )


def _violations(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over a table: one counter per rule, then one row per rule."""
    counts = df.agg(*[F.count_if(bad).alias(rule) for rule, bad in rules.items()])
    return counts.select(
        F.lit(name).alias("table_name"),
        F.inline(
            F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])
        ),
    )


def contract_violations(conversations: DataFrame, events: DataFrame) -> DataFrame:
    repeated = (
        conversations.groupBy("trace_id")
        .count()
        .agg(F.count_if(F.col("count") > 1).alias("violations"))
        .select(F.lit("conversations").alias("table_name"), F.lit("trace_id_unique").alias("rule"), "violations")
    )
    return (
        _violations(conversations, "conversations", conversation_rules())
        .unionByName(_violations(events, "conversation_traces", event_rules()))
        .unionByName(repeated)
    )


def load_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, as checked after a load."""
    counted = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def undeclared_fields(events: DataFrame) -> DataFrame:
    """Payload fields that no contract declares, by event kind: the log's extra fields."""
    extra = F.array_except(F.json_object_keys("metadata"), F.array(*[F.lit(n) for n in PAYLOAD]))
    return (
        events.select("event_type", F.explode(extra).alias("field"))
        .groupBy("event_type", "field")
        .agg(F.count("*").alias("events"))
    )
