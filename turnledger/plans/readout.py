"""Business and operations readouts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scoring import ratio
from turnledger.plans.evaluation import PERCENTILES

# Yearly contacts and handle minutes per channel, dollars per agent
# minute, and the model cost per call used when no run carries one.
YEARLY_CONTACTS = {"voice": 60_000_000, "chat": 40_000_000, "all": 100_000_000}
HANDLE_MINUTES = {"voice": 6, "chat": 4, "all": 6}
AGENT_COST_PER_MINUTE = 0.85
DEFAULT_CALL_COST = 0.0014


def cohort_containment(conversations: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Containment of every channel and of all together, in one aggregation. A channel
    without conversations takes ``fallback``."""
    counts = []
    for channel in YEARLY_CONTACTS:
        mine = F.lit(True) if channel == "all" else F.col("modality") == channel
        counts.append(
            F.struct(
                F.lit(channel).alias("channel"),
                F.count_if(mine).alias("n"),
                F.count_if(mine & (F.col("outcome") == "contained")).alias("contained"),
            ).alias(channel)
        )
    rows = conversations.agg(*counts).select(F.inline(F.array(*YEARLY_CONTACTS)))
    instead = F.lit(None).cast("double") if fallback is None else fallback
    measured = ratio(F.col("contained"), F.col("n"))
    return rows.select("channel", "n", F.when(F.col("n") > 0, measured).otherwise(instead).alias("containment"))


def _per_channel(table: dict[str, int]) -> Column:
    rule = F
    for channel, value in table.items():
        rule = rule.when(F.col("channel") == channel, F.lit(value))
    return rule


def business_readout(conversations: DataFrame, runs: DataFrame) -> DataFrame:
    """Contained calls and displaced cost per channel and year. A channel nobody has used
    yet is rated by the latest run."""
    newest = F.max_by(F.struct("cost_per_call_usd", "containment_rate"), F.struct("created_at", "run_id"))
    latest = runs.agg(newest).scalar()
    contained = F.floor(F.col("containment") * _per_channel(YEARLY_CONTACTS) + 0.5)
    agent_cost = F.lit(AGENT_COST_PER_MINUTE) * _per_channel(HANDLE_MINUTES)
    rows = cohort_containment(conversations, latest["containment_rate"]).select(
        "channel",
        "n",
        "containment",
        contained.alias("contained_calls"),
        agent_cost.alias("agent_cost_per_call"),
        F.coalesce(latest["cost_per_call_usd"], F.lit(DEFAULT_CALL_COST)).alias("llm_cost_per_call"),
    )
    displaced = F.col("contained_calls") * (F.col("agent_cost_per_call") - F.col("llm_cost_per_call"))
    return rows.withColumn("displaced_cost_usd", F.round(displaced, 2))


def containment_sensitivity(conversations: DataFrame, points: int = 5) -> DataFrame:
    """What each percentage point of containment is worth, around the measured rate."""
    base = cohort_containment(conversations)
    steps = F.sequence(F.lit(-points).cast("long"), F.lit(points).cast("long"))
    rows = base.select("channel", "containment", F.explode(steps).alias("points"))
    calls = _per_channel(YEARLY_CONTACTS) * F.col("points") / 100.0
    minutes = calls * _per_channel(HANDLE_MINUTES)
    return rows.select(
        "channel",
        "points",
        F.round(F.col("containment") + F.col("points") / 100.0, 6).alias("containment"),
        F.round(calls / 365.0, 2).alias("contacts_per_day"),
        F.round(minutes / 365.0, 2).alias("minutes_per_day"),
        F.round(minutes * AGENT_COST_PER_MINUTE / 365.0, 2).alias("usd_per_day"),
        F.round(minutes * AGENT_COST_PER_MINUTE, 2).alias("usd_per_year"),
    )


def outcome_matrix(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("modality", "outcome").agg(F.count("*").alias("conversations"))


def conversation_kpis(conversations: DataFrame) -> DataFrame:
    """Headline rates per channel, with the average turns of contained conversations."""
    contained = F.col("outcome") == "contained"
    return conversations.groupBy("modality").agg(
        F.count("*").alias("conversations"),
        ratio(F.count_if(contained), F.count("*")).alias("containment_rate"),
        ratio(F.count_if(F.col("outcome") == "escalated"), F.count("*")).alias("escalation_rate"),
        ratio(F.count_if(F.col("outcome") == "refused"), F.count("*")).alias("refusal_rate"),
        ratio(F.sum(F.when(contained, F.col("turns")).otherwise(0)), F.count_if(contained)).alias("turns_to_resolution"),
        F.count_if(F.col("customer_id").isNull()).alias("anonymous"),
    )


def daily_cost(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("conversations"),
        F.sum("cost_micro").alias("cost_micro"),
        (F.sum("cost_micro") / 1e6).alias("cost_usd"),
    )


def outcome_windows(conversations: DataFrame, width: str = "1 hour") -> DataFrame:
    """Outcome counts per tumbling window and channel; the batch twin of the stream."""
    return (
        conversations.groupBy(F.window("created_at", width).alias("w"), "modality")
        .agg(
            F.count("*").alias("conversations"),
            F.count_if(F.col("outcome") == "contained").alias("contained"),
            F.count_if(F.col("outcome") == "escalated").alias("escalated"),
            F.count_if(F.col("outcome") == "refused").alias("refused"),
        )
        .select(
            F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
            "modality",
            "conversations",
            "contained",
            "escalated",
            "refused",
            ratio(F.col("refused"), F.col("conversations")).alias("refusal_rate"),
        )
    )


def refusal_spikes(conversations: DataFrame, width: str = "1 hour", factor: float = 2.0, least: int = 5) -> DataFrame:
    """Windows of a channel in which at least ``least`` conversations were refused and the
    refusal rate is over ``factor`` times the channel's own."""
    windows = outcome_windows(conversations, width)
    usual = windows.groupBy("modality").agg(ratio(F.sum("refused"), F.sum("conversations")).alias("usual_rate"))
    spike = (F.col("refused") >= least) & (F.col("refusal_rate") > factor * F.col("usual_rate"))
    return windows.join(usual, "modality").where(spike).select(
        "window_start", "modality", "conversations", "refused", "refusal_rate", "usual_rate"
    )


# --- alerts -------------------------------------------------------------------------

ALERT_COLUMNS = "window_start timestamp, modality string, conversations long, refused long, refusal_rate double, usual_rate double"


@dataclass(frozen=True)
class Decay:
    """What counts as a spike of refusals against a channel's own past.

    The usual rate is refused over all conversations, both halved every ``half_life_hours``;
    a window is judged by the windows before it and only then joins them.
    """

    half_life_hours: float = 24.0
    factor: float = 2.0
    least: int = 5
    history: float = 20.0  # conversations that the past must weigh before it judges

    def judge(
        self, windows: Iterable[tuple[int, int, int]], past: tuple[float, float, int] | None
    ) -> tuple[list[tuple], tuple[float, float, int] | None]:
        """Spikes among ordered windows (start in seconds, conversations, refused), and the past
        after them: (refused, conversations, start of the last window)."""
        found = []
        for start, conversations, refused in windows:
            if past is not None:
                weight = 0.5 ** ((start - past[2]) / 3600 / self.half_life_hours)
                past = (past[0] * weight, past[1] * weight, start)
                if past[1] >= self.history and refused >= self.least:
                    rate, usual = refused / conversations, past[0] / past[1]
                    if rate > self.factor * usual:
                        found.append((start, conversations, refused, round(rate, 9), round(usual, 9)))
            else:
                past = (0.0, 0.0, start)
            past = (past[0] + refused, past[1] + conversations, start)
        return found, past


def refusal_windows(conversations: DataFrame, width: str = "1 hour") -> DataFrame:
    """Conversations and refusals per channel and window."""
    return (
        conversations.groupBy(F.window("created_at", width).alias("w"), "modality")
        .agg(F.count("*").alias("conversations"), F.count_if(F.col("outcome") == "refused").alias("refused"))
        .select(F.col("w.start").alias("window_start"), "modality", "conversations", "refused")
    )


def refusal_alerts(conversations: DataFrame, width: str = "1 hour", decay: Decay = Decay()) -> DataFrame:
    """Windows whose refusal rate stands out of their channel's decayed past, in time order.

    Only the window counts of a channel meet in one task: a row per window of the calendar.
    """

    def judge(key: tuple, windows: pd.DataFrame) -> pd.DataFrame:
        windows = windows.sort_values("window_start")
        starts = windows["window_start"].astype("datetime64[s]").astype("int64")
        found, _ = decay.judge(zip(starts, windows["conversations"], windows["refused"], strict=True), None)
        return alert_frame(key[0], found)

    counted = refusal_windows(conversations, width).where(F.col("modality").isNotNull())
    return counted.groupBy("modality").applyInPandas(judge, ALERT_COLUMNS)


def alert_frame(modality: str, found: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(found, columns=["window_start", "conversations", "refused", "refusal_rate", "usual_rate"])
    frame.insert(1, "modality", modality)
    kinds = {"modality": "object", "conversations": "int64", "refused": "int64", "refusal_rate": "float64", "usual_rate": "float64"}
    return frame.assign(window_start=pd.to_datetime(frame["window_start"], unit="s")).astype(kinds)


# --- mergeable percentiles ------------------------------------------------------------

ACCURACY = 0.01
_GROWTH = (1 + ACCURACY) / (1 - ACCURACY)


def latency_sketches(conversations: DataFrame, latency: str = "latency_p50_ms", width: str = "1 hour") -> DataFrame:
    """A sketch of the latencies of every window and channel: counts by logarithmic bucket.

    A bucket holds the values within one percent of its middle, so a sketch has some hundred
    rows whatever the traffic. Sketches of any windows merge by adding their counts.
    """
    bucket = F.ceil(F.ln(F.col(latency)) / F.lit(math.log(_GROWTH))).cast("int")
    return (
        conversations.where(F.col(latency) > 0)
        .groupBy(F.window("created_at", width).alias("w"), "modality", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "modality", "bucket", "n")
    )


def merged_percentiles(sketches: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """Nearest-rank percentiles of the merged sketches of a key, each within ``ACCURACY`` of
    the exact one."""
    merged = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(
        *keys, "bucket", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total")
    )

    def at(p: float) -> Column:
        rank = F.rint(F.lit(p) * (F.col("total") - 1)) + 1
        bucket = F.min(F.when(F.col("upto") >= rank, F.col("bucket")))
        return F.round(2 * F.pow(F.lit(_GROWTH), bucket) / (_GROWTH + 1), 3)

    return ranked.groupBy(*keys).agg(F.sum("n").alias("measured"), *[at(p).alias(name) for name, p in percentiles.items()])


def rolling_percentiles(sketches: DataFrame, hours: int = 24) -> DataFrame:
    """Percentiles over the trailing ``hours`` of every window: each sketch is handed to the
    windows that still see it, then merged. No value is read again."""
    known = sketches.select("window_start", "modality").distinct()
    later = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("ahead")
    seen = sketches.select("*", later).withColumn(
        "window_start", F.col("window_start") + F.make_dt_interval(hours=F.col("ahead"))
    )
    return merged_percentiles(seen.join(known, ["window_start", "modality"], "left_semi"), ["window_start", "modality"])


def intent_drift(rows: DataFrame, split: date, intent: str = "journey", at: str = "created_at") -> DataFrame:
    """Share of each intent before and after ``split`` and its part of the population
    stability index; the index is the sum of the parts."""
    later = F.col(at) >= F.lit(split).cast("timestamp")
    counts = rows.groupBy(F.col(intent).alias("intent")).agg(
        F.count_if(~later).alias("before"), F.count_if(later).alias("after")
    )
    # a handful of intent rows by now: the totals are a window, not two more scans
    everything = Window.partitionBy(F.lit(0))
    shares = counts.select(
        "intent",
        "before",
        "after",
        ratio(F.col("before"), F.sum("before").over(everything)).alias("p"),
        ratio(F.col("after"), F.sum("after").over(everything)).alias("q"),
    )
    part = F.when(
        (F.col("p") > 0) & (F.col("q") > 0), (F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))
    )
    return shares.select("intent", "before", "after", "p", "q", F.round(part, 9).alias("psi_part"))
