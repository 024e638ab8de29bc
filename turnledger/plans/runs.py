"""Run tables: reading, long form, trends, comparison and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.text import iso_millis
from turnledger.schemas import (
    DEFAULT_CONFIG_HASH,
    DEFAULT_TOTAL_QUERIES,
    GATE_TARGETS,
    JOURNEY_QUERY_SHARES,
    RUN_METRIC_COLUMNS,
    RUN_SOURCES,
    SAMPLE_MODALITIES,
    SPECIALIST_JOURNEYS,
)


def run_list(runs: DataFrame) -> DataFrame:
    """Run summaries with the read defaults applied."""
    return runs.select(
        "run_id",
        "created_at",
        iso_millis("created_at").alias("run_timestamp"),
        "git_sha",
        F.lit(DEFAULT_CONFIG_HASH).alias("config_hash"),
        F.coalesce("sample_size", F.lit(DEFAULT_TOTAL_QUERIES)).alias("total_queries"),
        F.when(F.col("source").isin(*RUN_SOURCES), F.col("source")).otherwise("golden").alias("source"),
        F.when(F.col("sample_modality").isin(*SAMPLE_MODALITIES), F.col("sample_modality")).alias("sample_modality"),
        *RUN_METRIC_COLUMNS.values(),
        *[f"task_success_{j}" for j in SPECIALIST_JOURNEYS],
    )


def newest_first(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """All runs, or the newest few where a page asks for so many."""
    listed = run_list(runs).orderBy(F.desc("created_at"), F.desc("run_id"))
    return listed if limit is None else listed.limit(limit)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return run_list(runs.where(F.col("run_id") == run_id))


def metrics_long(listed: DataFrame) -> DataFrame:
    """Wide to long: one row per run and metric, and per journey for task success.

    Null metrics leave no row. Query counts per journey are the fixed read shares of
    the total, as stored rows do not carry them.
    """
    shown = {c: m for m, c in RUN_METRIC_COLUMNS.items()}
    shown.update({f"task_success_{j}": "task_success" for j in SPECIALIST_JOURNEYS})
    ids = ["run_id", "created_at", "run_timestamp", "git_sha", "config_hash", "source", "sample_modality", "total_queries"]
    values = [F.col(c).cast("double").alias(c) for c in shown]
    long = listed.select(*ids, *values).unpivot(ids, list(shown), "column", "metric_value")
    long = long.where(F.col("metric_value").isNotNull())
    journey: Column = F.lit(None).cast("string")
    name: Column = F.lit(None).cast("string")
    share: Column = F.lit(None).cast("double")
    for column, metric in shown.items():
        here = F.col("column") == column
        name = F.when(here, metric).otherwise(name)
        if metric == "task_success":
            j = column.removeprefix("task_success_")
            journey = F.when(here, j).otherwise(journey)
            share = F.when(here, JOURNEY_QUERY_SHARES[j]).otherwise(share)
    return long.select(
        *ids,
        name.alias("metric_name"),
        journey.alias("journey"),
        "metric_value",
        F.rint(F.col("total_queries") * share).cast("long").alias("query_count"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest golden run, or the newest run of any kind; and the greatest run id."""
    listed = run_list(runs)
    pick = F.struct((F.col("source") == "golden").alias("is_golden"), "created_at", "run_id")
    return listed.agg(
        F.max_by(F.struct("run_id", "source", "run_timestamp", "containment_rate"), pick).alias("r"),
        F.max("run_id").alias("greatest_run_id"),
    ).select("r.*", "greatest_run_id")


def metric_trend(long: DataFrame, source: str = "golden") -> DataFrame:
    """Per metric: position, change since the run before, and the sparkline point.

    A flat series has range 1. Groups here are runs of one metric, a few rows a day.
    """
    rows = long.where(F.col("source") == source)
    by = Window.partitionBy("metric_name", "journey")
    order = by.orderBy("created_at", "run_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.col("metric_value")
    low, high = F.min(value).over(by), F.max(value).over(by)
    return rows.select(
        "metric_name",
        "journey",
        "run_id",
        "metric_value",
        F.row_number().over(order).alias("run_number"),
        F.count("*").over(by).alias("runs"),
        F.round(value - F.lag(value).over(order), 9).alias("delta"),
        F.round((value - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)), 9).alias("point"),
        (F.last(value).over(whole) >= F.first(value).over(whole)).alias("rising"),
    )


def run_compare(long: DataFrame, base_run: Column, new_run: Column) -> DataFrame:
    """Two runs side by side per metric; one pass, no self join."""
    rows = long.where(F.col("run_id").isin(base_run, new_run))
    out = rows.groupBy("metric_name", "journey").agg(
        F.max(F.when(F.col("run_id") == base_run, F.col("metric_value"))).alias("base_value"),
        F.max(F.when(F.col("run_id") == new_run, F.col("metric_value"))).alias("new_value"),
    )
    return out.select("*", F.round(F.col("new_value") - F.col("base_value"), 9).alias("change"))


def last_two(runs: DataFrame, source: str = "golden") -> tuple[Column, Column]:
    """Scalar subqueries for the run before the newest, and the newest."""
    mine = run_list(runs).where(F.col("source") == source)
    pair = mine.orderBy(F.desc("created_at"), F.desc("run_id")).limit(2)
    at = F.struct("created_at", "run_id")
    return (
        pair.agg(F.min_by("run_id", at)).scalar(),
        pair.agg(F.max_by("run_id", at)).scalar(),
    )


def metric_gate(long: DataFrame, targets: Sequence[tuple] = GATE_TARGETS, tolerance: float = 0.02) -> DataFrame:
    """Every golden run against the targets and the run before it.

    ``status`` is ``pass``, ``fail`` or ``n/a``; a run regresses when a metric moves
    against its direction by more than ``tolerance`` of the run before. A target is
    ``(metric, journey or None, ">=" or "<=", bound)``.
    """
    runs = long.where(F.col("source") == "golden")
    order = Window.partitionBy("metric_name", "journey").orderBy("created_at", "run_id")
    series = runs.select("run_id", "metric_name", "journey", "metric_value", F.lag("metric_value").over(order).alias("previous"))
    due = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_name"),
                F.lit(j).cast("string").alias("journey"),
                F.lit(d).alias("direction"),
                F.lit(float(b)).alias("bound"),
            )
            for m, j, d, b in targets
        ]
    )
    wanted = runs.select("run_id").distinct().select("run_id", F.inline(due))
    matched = wanted.alias("t").join(
        series.alias("s"),
        (F.col("t.run_id") == F.col("s.run_id"))
        & (F.col("t.metric_name") == F.col("s.metric_name"))
        & F.col("t.journey").eqNullSafe(F.col("s.journey")),
        "left",
    )
    value, previous, bound = F.col("s.metric_value"), F.col("s.previous"), F.col("t.bound")
    up = F.col("t.direction") == ">="
    good = F.when(up, value >= bound).otherwise(value <= bound)
    slack = F.abs(previous) * tolerance
    worse = F.when(up, value < previous - slack).otherwise(value > previous + slack)
    return matched.select(
        "t.run_id",
        "t.metric_name",
        "t.journey",
        "t.direction",
        "t.bound",
        value.alias("metric_value"),
        previous.alias("previous_value"),
        F.when(value.isNull(), "n/a").when(good, "pass").otherwise("fail").alias("status"),
        F.coalesce(worse, F.lit(False)).alias("regressed"),
    )
