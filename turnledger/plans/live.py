"""Live voice sessions in batch: turn assembly and session figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.scoring import ratio
from turnledger.functions.text import redact, strip
from turnledger.operators import ordered
from turnledger.operators.ranking import at_rank, with_ranks
from turnledger.schemas import DEFAULT_POLICY, HANDOVER_TOOL

PREVIEW_CHARS = 200


def _said(kind: str) -> Column:
    """The fragments of one speaker in one turn, joined in order; the session ceiling
    bounds how many there can be."""
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "text"))))
    return strip(F.array_join(F.transform(parts, lambda p: p["text"]), ""))


def assemble_turns(fragments: DataFrame) -> DataFrame:
    """Turn fragments into the rows the voice channel logs.

    A turn ends at ``turn_complete``; its text is written then. ``interrupted`` drops
    what the agent had said so far in the turn and logs it as cancelled. Only turns
    with user speech are counted. Text after the last turn end is still open and gives
    no row.
    """
    pages = ordered.page_slice("seq", 4_000_000)
    ends = (F.col("kind") == "turn_complete").cast("long")
    cuts = (F.col("kind") == "interrupted").cast("long")
    marked = ordered.running_sums(
        fragments, ["trace_id"], pages, ["seq"], {"ends_upto": ends, "cuts_upto": cuts}
    ).withColumns({"segment": F.col("ends_upto") - ends, "era": F.col("cuts_upto") - cuts})

    users = marked.groupBy("trace_id", "segment").agg(
        F.bool_or(F.col("kind") == "turn_complete").alias("complete"), _said("user_fragment").alias("user_text")
    )
    spoken = F.when(F.col("user_text") != "", 1).otherwise(0).cast("long")
    turns = ordered.running_sums(
        users.where("complete"), ["trace_id"], ordered.page_slice("segment", 4096), ["segment"], {"turn": spoken}
    )
    agents = marked.groupBy("trace_id", "segment", "era").agg(
        F.bool_or(F.col("kind") == "interrupted").alias("cut"), _said("assistant_fragment").alias("agent_text")
    )

    said = turns.where(F.col("user_text") != "").select(
        "trace_id", "segment", "turn", F.lit("live_user_transcript").alias("event_type"), redact("user_text").alias("r")
    ).select("trace_id", "segment", "turn", "event_type", F.col("r.text").alias("text"), F.col("r.redacted").alias("pii_redacted"))
    # no text is written for a turn that is still open
    replied = agents.where(~F.col("cut") & (F.col("agent_text") != "")).join(
        turns.select("trace_id", "segment", "turn"), ["trace_id", "segment"]
    )
    cancelled = agents.where("cut").select(
        "trace_id",
        "segment",
        F.lit(None).cast("long").alias("turn"),
        F.lit("live_interruption").alias("event_type"),
        F.col("agent_text").alias("text"),
        F.lit(False).alias("pii_redacted"),
    )
    written = replied.select(
        "trace_id",
        "segment",
        "turn",
        F.lit("live_assistant_text").alias("event_type"),
        F.col("agent_text").alias("text"),
        F.lit(False).alias("pii_redacted"),
    )
    return said.unionByName(written).unionByName(cancelled).withColumn("preview", preview())


def preview() -> Column:
    """The start of what an interruption cut off; the full words stay in ``text``."""
    return F.when(F.col("event_type") == "live_interruption", F.substring("text", 1, PREVIEW_CHARS))


def session_rows(fragments: DataFrame) -> DataFrame:
    """One row per session with the figures its close event carries; only turns in which
    the user spoke are counted."""
    kind = F.col("kind")
    figures = fragments.groupBy("trace_id").agg(
        F.floor((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1000).alias("duration_ms"),
        F.count_if(kind == "interrupted").alias("interruptions"),
        F.count_if(kind == "tool_call").alias("tool_calls"),
    )
    spoken = (
        assemble_turns(fragments)
        .where(F.col("event_type") == "live_user_transcript")
        .groupBy("trace_id")
        .agg(F.count("*").alias("turns"))
    )
    turns = F.greatest(F.lit(1), F.coalesce("turns", F.lit(0))).alias("turns")
    return figures.join(spoken, "trace_id", "left").select(*figures.columns, turns)


def bounded_sessions(fragments: DataFrame, ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds) -> DataFrame:
    """Add ``in_session``: a session ends with its first ``session_close``, or at the ceiling
    counted from its first fragment; what comes after is late."""
    in_time = F.col("timestamp") <= F.col("__first") + F.make_dt_interval(secs=F.lit(ceiling_seconds))
    starts = fragments.groupBy("trace_id").agg(F.min("timestamp").alias("__first"))
    timed = fragments.join(starts, "trace_id").withColumn("__in_time", in_time)
    ends = timed.where(F.col("__in_time") & (F.col("kind") == "session_close"))
    ends = ends.groupBy("trace_id").agg(F.min("seq").alias("__end"))
    open_ = F.coalesce(F.col("seq") <= F.col("__end"), F.lit(True))
    return timed.join(ends, "trace_id", "left").select(
        *fragments.columns, (F.col("__in_time") & open_).alias("in_session")
    )


def session_closes(fragments: DataFrame, ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds) -> DataFrame:
    """The close row of every session: how long it was, its turns (one at least), whether it
    was handed over, and what arrived too late to count."""
    marked = bounded_sessions(fragments, ceiling_seconds)
    inside = marked.where("in_session").drop("in_session")
    kind, at = F.col("kind"), F.unix_micros("timestamp")
    more = marked.groupBy("trace_id").agg(
        F.coalesce(F.bool_or(F.col("in_session") & (kind == "tool_call") & (tool_name() == HANDOVER_TOOL)), F.lit(False)).alias(
            "escalated"
        ),
        F.count_if(~F.col("in_session")).alias("late_fragments"),
        F.max(F.when(F.col("in_session"), F.col("timestamp"))).alias("closed_at"),
        F.floor((F.max(F.when(F.col("in_session"), at)) - F.min(at)) / 1000).alias("open_ms"),
        F.floor(
            (F.min(F.when(F.col("in_session") & (kind == "assistant_fragment"), at)) - F.min(at)) / 1000
        ).alias("first_audio_ms"),
    )
    return session_rows(inside).join(more, "trace_id").select(
        "trace_id",
        F.lit("live_session_close").alias("event_type"),
        F.col("open_ms").alias("duration_ms"),
        "turns",
        "escalated",
        outcome_of("escalated").alias("outcome"),
        "interruptions",
        "tool_calls",
        "first_audio_ms",
        "late_fragments",
        "closed_at",
    )


def tool_name() -> Column:
    """The tool of a ``tool_call``: its text is the name or a JSON record of the call."""
    return F.coalesce(F.get_json_object("text", "$.tool_name"), F.col("text"))


def outcome_of(escalated: str) -> Column:
    return F.when(F.col(escalated), "escalated").otherwise("contained")


def close_summaries(closes: DataFrame) -> DataFrame:
    """Close rows as rows of the conversation summary. A live session is a voice
    conversation there; its cost is not known."""
    none = F.lit(None).cast("string")
    return closes.where(F.col("event_type") == "live_session_close").select(
        "trace_id",
        F.lit("voice").alias("modality"),
        none.alias("customer_id"),
        none.alias("tier"),
        none.alias("journey"),
        "outcome",
        "turns",
        F.col("duration_ms").alias("latency_p50_ms"),
        F.lit(0).cast("long").alias("cost_micro"),
        F.col("closed_at").alias("created_at"),
    )


def tool_calls(fragments: DataFrame, ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds) -> DataFrame:
    """The log row of every tool call made while its session was open."""
    inside = bounded_sessions(fragments, ceiling_seconds).where(F.col("in_session") & (F.col("kind") == "tool_call"))
    return inside.select(
        "trace_id",
        "seq",
        F.lit("live_tool_call").alias("event_type"),
        tool_name().alias("tool_name"),
        F.get_json_object("text", "$.result_preview").alias("result_preview"),
    )


def tool_mix(fragments: DataFrame, ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds) -> DataFrame:
    """Calls of each tool, the sessions that made them, and the share of all calls."""
    used = tool_calls(fragments, ceiling_seconds).groupBy("tool_name", "trace_id").agg(F.count("*").alias("n"))
    mix = used.groupBy("tool_name").agg(F.sum("n").alias("calls"), F.count("*").alias("sessions"))
    total = mix.agg(F.sum("calls")).scalar()
    return mix.select("tool_name", "calls", "sessions", ratio("calls", total).alias("share"))


def live_session_kpis(fragments: DataFrame, ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds) -> DataFrame:
    by_duration = session_rows(fragments).groupBy("duration_ms").agg(
        F.count("*").alias("sessions"),
        F.sum("turns").alias("turns"),
        F.count_if(F.col("interruptions") > 0).alias("cut"),
        F.sum("tool_calls").alias("tool_calls"),
    )
    over = F.col("duration_ms") > ceiling_seconds * 1000
    return with_ranks(by_duration, [], "duration_ms", "sessions").agg(
        F.sum("sessions").alias("sessions"),
        ratio(F.sum("turns"), F.sum("sessions")).alias("turns_per_session"),
        ratio(F.sum("cut"), F.sum("sessions")).alias("barge_in_rate"),
        F.sum("tool_calls").alias("tool_calls"),
        F.coalesce(F.sum(F.when(over, F.col("sessions"))), F.lit(0)).alias("over_ceiling"),
        at_rank("duration_ms", 0.5).alias("duration_p50_ms"),
        at_rank("duration_ms", 0.95).alias("duration_p95_ms"),
    )
