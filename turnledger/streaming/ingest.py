"""Streaming ingest of the trace log, conversation summaries and rolling rates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnledger.plans.readout import ALERT_COLUMNS, Decay, alert_frame, latency_sketches, outcome_windows, refusal_windows
from turnledger.plans.traces import event_rules, quarantine
from turnledger.schemas import PARTIALS, struct_of
from turnledger.sources.listing import Manifest, commit, read_manifest, vacuum

LATENESS = "10 minutes"


def deduplicated(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop repeated events by id; state older than the watermark is let go."""
    return log.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to the day-partitioned log."""
    return (
        log.withColumn("event_date", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def quarantine_log(log: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the log rows that break a rule, with the rules, one folder per batch."""
    return (
        log.writeStream.foreachBatch(batch_folder(root, lambda rows: quarantine(rows, event_rules())))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- conversation summaries ------------------------------------------------------


def summary_partials(log: DataFrame) -> DataFrame:
    """What one batch adds to each trace. Partials of any batches can be merged."""
    at = F.struct("created_at", "latency_p50_ms", "outcome")
    return log.groupBy("trace_id").agg(
        F.max_by(F.struct("modality", "customer_id", "tier", "journey", "outcome", "latency_p50_ms"), at).alias("latest"),
        F.max(at).alias("latest_at"),
        F.sum("turns").alias("turns"),
        F.sum("cost_micro").alias("cost_micro"),
        F.min("created_at").alias("created_at"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of a trace as one partial: merging may be done in any grouping."""
    return partials.groupBy("trace_id").agg(
        F.max_by("latest", "latest_at").alias("latest"),
        F.max("latest_at").alias("latest_at"),
        F.sum("turns").alias("turns"),
        F.sum("cost_micro").alias("cost_micro"),
        F.min("created_at").alias("created_at"),
    )


def summaries_of(partials: DataFrame) -> DataFrame:
    return merge_partials(partials).select("trace_id", "latest.*", "turns", "cost_micro", "created_at")


def batch_folder(root: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer with one folder per batch. A replayed batch replaces
    its own folder, so a failure between write and commit changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return write


FAN_IN = 8  # segments of a level that become one of the next


class SummaryStore:
    """One partial per trace and segment, in levels, under a manifest.

    A batch adds a segment to level 0. ``FAN_IN`` segments of a level are merged into one of
    the next, so after ``b`` batches a read opens fewer than ``FAN_IN`` segments per level and
    there are about ``log(b)`` levels; a row is rewritten once per level. The manifest names
    the live segments and the batches in each. A batch that is already in it is not written
    again, whatever level it has moved to, and a failure before the commit changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.fan_in = spark, root, fan_in

    def segments(self, manifest: Manifest | None = None) -> list[dict]:
        """Live segments: level, name, first and last batch; a segment holds every batch
        between its two."""
        return (manifest or read_manifest(self.spark, self.root)).entries.get("segments", [])

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> dict:
        name = f"level{level}-{first:09d}-{last:09d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/segments/{name}")
        return {"level": level, "name": name, "first": first, "last": last}

    def _read(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema(PARTIALS).parquet(*[f"{self.root}/segments/{s['name']}" for s in segments])

    def add(self, partials: DataFrame, batch_id: int) -> None:
        """Add a batch and compact the levels that are full; one commit for both."""
        before = read_manifest(self.spark, self.root)
        live = self.segments(before)
        if any(s["first"] <= batch_id <= s["last"] for s in live):
            return
        live = [*live, self._write(partials, 0, batch_id, batch_id)]
        level = 0
        while len(full := [s for s in live if s["level"] == level]) >= self.fan_in:
            merged = merge_partials(self._read(full))
            one = self._write(merged, level + 1, min(s["first"] for s in full), max(s["last"] for s in full))
            live = [s for s in live if s["level"] != level] + [one]
            level += 1
        commit(self.spark, self.root, before, {"segments": live})
        used = {s["name"] for s in [*live, *self.segments(before)]}
        vacuum(self.spark, self.root, {f"{self.root}/segments": used})

    def read(self) -> DataFrame:
        """The current summary of every trace."""
        live = self.segments()
        return summaries_of(self._read(live) if live else self.spark.createDataFrame([], PARTIALS))


def upsert_summaries(log: DataFrame, root: str, checkpoint: str, fan_in: int = FAN_IN) -> StreamingQuery:
    """Keep one summary per trace: batches add partials, levels of them are merged."""

    def write(batch: DataFrame, batch_id: int) -> None:
        SummaryStore(batch.sparkSession, root, fan_in).add(summary_partials(batch), batch_id)

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_summaries(spark: SparkSession, root: str) -> DataFrame:
    return SummaryStore(spark, root).read()


# --- rolling rates -----------------------------------------------------------------


def rolling_outcomes(summaries: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Outcome counts per closed window; rows later than the watermark are left to the
    batch job over the same table."""
    return outcome_windows(summaries.withWatermark("created_at", lateness), width)


# --- alerts and sketches -----------------------------------------------------------

_PAST = struct_of(("refused", T.DoubleType(), True), ("conversations", T.DoubleType(), True), ("start", T.LongType(), True))


class SpikeWatch(StatefulProcessor):
    """Keeps the decayed past of a channel and judges every window as it closes.

    Windows of a key close in time order: one that closes in a later batch ends after the
    watermark of this one.
    """

    def __init__(self, decay: Decay) -> None:
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", _PAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows), ignore_index=True).sort_values("window_start")
        starts = windows["window_start"].astype("datetime64[s]").astype("int64")
        past = tuple(self.past.get()) if self.past.exists() else None
        found, past = self.decay.judge(zip(starts, windows["conversations"], windows["refused"]), past)
        self.past.update((float(past[0]), float(past[1]), int(past[2])))
        yield alert_frame(key[0], found)

    def close(self) -> None:
        pass


def refusal_alert_stream(
    conversations: DataFrame, width: str = "1 hour", lateness: str = LATENESS, decay: Decay = Decay()
) -> DataFrame:
    """Refusal spikes of closed windows, each judged by the windows before it.

    Rows are counted per window first, so a channel's state sees a row per window.
    """
    closed = refusal_windows(conversations.withWatermark("created_at", lateness), width)
    return (
        closed.where(F.col("modality").isNotNull())
        .groupBy("modality")
        .transformWithStateInPandas(
            statefulProcessor=SpikeWatch(decay),
            outputStructType=T._parse_datatype_string(ALERT_COLUMNS),
            outputMode="Append",
            timeMode="None",
        )
    )


def sketch_latencies(conversations: DataFrame, root: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Store the latency sketches of every batch; readers merge them by adding counts."""
    return (
        conversations.writeStream.foreachBatch(batch_folder(root, lambda rows: latency_sketches(rows, width=width)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
