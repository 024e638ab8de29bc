"""Live voice sessions as a keyed stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnledger.functions.text import redact
from turnledger.plans.live import close_summaries, outcome_of, preview
from turnledger.plans.retrieval import grounding_check
from turnledger.schemas import DEFAULT_POLICY, HANDOVER_TOOL, struct_of
from turnledger.streaming.ingest import LATENESS, batch_folder

_L, _S = T.LongType(), T.StringType()
OUTPUT = struct_of(
    ("trace_id", _S, True),
    ("segment", _L, True),
    ("turn", _L, True),
    ("event_type", _S, True),
    ("text", _S, True),
    ("tool_name", _S, True),
    ("duration_ms", _L, True),
    ("escalated", T.BooleanType(), True),
    ("closed_us", _L, True),
)
_PENDING = struct_of(("seq", _L, True), ("kind", _S, True), ("text", _S, True))
_SESSION = struct_of(
    ("segment", _L, True),
    ("turn", _L, True),
    ("flushed_seq", _L, True),
    ("first_us", _L, True),
    ("last_us", _L, True),
    ("escalated", T.BooleanType(), True),
)
_TOMBSTONE = struct_of(("expires_ms", _L, True))
RETENTION_SECONDS = 7 * 24 * 3600


class TurnAssembler(StatefulProcessor):
    """Holds the open turn of a session: fragments by sequence number and counters.

    A session ends with its ``session_close`` or at the ceiling. Fragments of the open turn
    may arrive in any order and in any batch; one that belongs to a turn already written
    comes out as ``live_late_fragment`` for the batch job to reconcile. A closed session
    leaves a tombstone that outlives it by ``retention_seconds``: whatever arrives for it
    is late as well, and no second session begins.
    """

    def __init__(
        self,
        ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds,
        retention_seconds: int = RETENTION_SECONDS,
    ) -> None:
        self.ceiling_ms = ceiling_seconds * 1000
        self.retention_ms = retention_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.session = handle.getValueState("session", _SESSION)
        self.tombstone = handle.getValueState("tombstone", _TOMBSTONE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trace_id = key[0]
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        batch["text"] = batch["text"].where(batch["text"].notna(), None)
        late = lambda text: _row(trace_id, "live_late_fragment", text=text)
        if self.tombstone.exists():
            yield _frame([late(t) for t in batch["text"]])
            return
        micros = batch["timestamp"].astype("datetime64[us]").astype("int64")
        if self.session.exists():
            segment, turn, flushed, first, last, escalated = self.session.get()
        else:
            segment, turn, flushed, first, last, escalated = 0, 0, -1, int(micros.min()), int(micros.min()), False
            self.handle.registerTimer(first // 1000 + self.ceiling_ms)
        events = [tuple(p) for p in self.pending.get()]
        out, closed = [], False
        for seq, at, kind, text in zip(batch["seq"], micros, batch["kind"], batch["text"]):
            if closed or at > first + self.ceiling_ms * 1000 or (seq <= flushed and kind not in ("tool_call", "session_close")):
                out.append(late(text))
                continue
            last = max(last, int(at))
            if kind == "tool_call":
                name, result = _tool(text)
                escalated = escalated or name == HANDOVER_TOOL
                out.append(_row(trace_id, "live_tool_call", segment=segment, tool_name=name, text=result))
            elif kind == "session_close":
                closed = True
            else:
                events.append((int(seq), kind, text))
        events.sort(key=lambda e: e[0])
        ends = [i for i, e in enumerate(events) if e[1] == "turn_complete"]
        done = ends[-1] + 1 if ends else 0
        open_turn = []
        for seq, kind, text in events[:done]:
            if kind != "turn_complete":
                open_turn.append((seq, kind, text))
                continue
            said, replied, cancelled = _split(open_turn)
            out.extend(_row(trace_id, "live_interruption", segment=segment, text=c) for c in cancelled)
            if said:
                turn += 1
                out.append(_row(trace_id, "live_user_transcript", segment=segment, turn=turn, text=said))
            if replied:
                out.append(_row(trace_id, "live_assistant_text", segment=segment, turn=turn, text=replied))
            segment, flushed, open_turn = segment + 1, seq, []
        self.pending.clear()
        if closed:
            out.extend(self._close(trace_id, (segment, turn, flushed, first, last, escalated), events[done:]))
        else:
            if events[done:]:
                self.pending.put(events[done:])
            self.session.update((segment, turn, flushed, first, last, escalated))
        yield _frame(out)

    def _close(self, trace_id: str, session: tuple, rest: list[tuple]) -> list[tuple]:
        """Interruptions of an open turn are written, its unfinished speech is not."""
        segment, turn, _, first, last, escalated = session
        out = [_row(trace_id, "live_interruption", segment=segment, text=c) for c in _split(sorted(rest))[2]]
        out.append(
            _row(
                trace_id,
                "live_session_close",
                turn=max(turn, 1),
                duration_ms=(last - first) // 1000,
                escalated=escalated,
                closed_us=last,
            )
        )
        expires = last // 1000 + self.ceiling_ms + self.retention_ms
        self.pending.clear()
        self.session.clear()
        self.tombstone.update((expires,))
        self.handle.registerTimer(expires)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The ceiling closes an open session; later the tombstone goes."""
        if self.tombstone.exists():
            if expiredTimerInfo.getExpiryTimeInMs() >= self.tombstone.get()[0]:
                self.tombstone.clear()
            yield _frame([])
        else:
            yield _frame(self._close(key[0], tuple(self.session.get()), [tuple(p) for p in self.pending.get()]))

    def close(self) -> None:
        pass


def _tool(text: str | None) -> tuple[str | None, str | None]:
    """Name and result of a tool call: its text is the name or a JSON record of the call."""
    try:
        call = json.loads(text or "")
    except ValueError:
        return text, None
    if not isinstance(call, dict) or "tool_name" not in call:
        return text, None
    return call["tool_name"], call.get("result_preview")


def _row(trace_id: str, event_type: str, **values) -> tuple:
    values |= {"trace_id": trace_id, "event_type": event_type}
    return tuple(values.get(name) for name in OUTPUT.fieldNames())


def _split(parts: list[tuple]) -> tuple[str, str, list[str]]:
    """User text, agent text that stood, and agent text cut off by each interruption."""
    said, spoken, cancelled = [], [], []
    for _, kind, text in parts:
        if kind == "user_fragment":
            said.append(text or "")
        elif kind == "assistant_fragment":
            spoken.append(text or "")
        elif kind == "interrupted":
            cancelled.append("".join(spoken).strip())
            spoken = []
    return "".join(said).strip(), "".join(spoken).strip(), cancelled


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=OUTPUT.fieldNames())
    whole = dict.fromkeys(("segment", "turn", "duration_ms", "closed_us"), "Int64")
    return frame.astype(whole | {"escalated": "boolean"})


def live_turn_stream(
    fragments: DataFrame,
    lateness: str = LATENESS,
    ceiling_seconds: int = DEFAULT_POLICY.session_ceiling_seconds,
    retention_seconds: int = RETENTION_SECONDS,
) -> DataFrame:
    """Turn fragments to log rows, with user text redacted on the way out."""
    rows = (
        fragments.withWatermark("timestamp", lateness)
        .groupBy("trace_id")
        .transformWithStateInPandas(
            statefulProcessor=TurnAssembler(ceiling_seconds, retention_seconds),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    # what may hold the customer's words or data
    user = F.col("event_type").isin("live_user_transcript", "live_late_fragment", "live_tool_call")
    closing = F.col("event_type") == "live_session_close"
    clean = redact("text")
    return rows.select(
        "trace_id",
        "segment",
        "turn",
        "event_type",
        F.when(user, clean["text"]).otherwise(F.col("text")).alias("text"),
        (user & clean["redacted"]).alias("pii_redacted"),
        preview().alias("preview"),
        "tool_name",
        "duration_ms",
        "escalated",
        F.when(closing, outcome_of("escalated")).alias("outcome"),
        F.timestamp_micros("closed_us").alias("closed_at"),
    )


def summary_of_closes(root: str):
    """A ``foreachBatch`` writer of the summary rows of closed sessions; a replayed batch
    replaces its own folder."""
    return batch_folder(root, lambda rows: close_summaries(rows.withColumnRenamed("turn", "turns")))


def verify_after_turn(turn_log: DataFrame, root: str, evidence: Sequence[str] = ("tool", "customer")):
    """A ``foreachBatch`` writer that grounds the replies of each batch on what is stored
    for their conversations in ``turn_log``: the results of tools and, unless ``evidence``
    leaves them out, the customer's words."""
    roles = {"live_assistant_text": "agent", "live_tool_call": "tool", "live_user_transcript": "customer"}
    role = F.coalesce(*[F.when(F.col("event_type") == kind, name) for kind, name in roles.items()])

    def verdicts(batch: DataFrame) -> DataFrame:
        touched = batch.where(F.col("event_type") == "live_assistant_text").select("trace_id").distinct()
        kept = turn_log.join(touched, "trace_id", "left_semi").select("trace_id", "turn", role.alias("role"), "text")
        return grounding_check(kept.where((F.col("role") != "agent") | F.col("turn").isNotNull()), evidence=evidence)

    return batch_folder(root, verdicts)
