"""Incremental evaluation: every micro-batch of new conversations becomes a run."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from turnledger.plans.evaluation import (
    production_results,
    production_run,
    reconstruct,
    with_turns,
)
from turnledger.schemas import EVAL_RUNS, TRACE_EVENTS
from turnledger.session import stored
from turnledger.sources.readers import read_log_days
from turnledger.sources.sinks import conform


def turns_to_judge(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """New conversations with their rebuilt turn; blank ones are left out."""
    log = events.join(conversations.select("trace_id"), "trace_id", "left_semi")
    return with_turns(conversations, reconstruct(log))


LOG_DAYS = 1  # how far the log of a conversation lies from its summary's day


def log_around(spark: SparkSession, path: str, conversations: DataFrame, days: int = LOG_DAYS) -> DataFrame:
    """The part of a day-partitioned log that can belong to the conversations: the folders
    of their days and of ``days`` before and after."""
    ends = conversations.agg(F.to_date(F.min("created_at")), F.to_date(F.max("created_at"))).first()
    if ends[0] is None:
        return spark.createDataFrame([], TRACE_EVENTS)
    more = timedelta(days=days)
    return read_log_days(spark, path, ends[0] - more, ends[1] + more)


def evaluate_stream(
    conversations: DataFrame,
    log_path: str,
    root: str,
    checkpoint: str,
    git_sha: str = "unknown",
    modality: str = "all",
    log_days: int = LOG_DAYS,
) -> StreamingQuery:
    """Judge what arrived since the last trigger and write one run row per batch.

    A batch is stored once and meets only the days of the log it can belong to. The session
    of a stream runs without adaptive execution, so the stored batch is judged in the
    caller's, where large partitions are cut and hot traces split. The
    checkpoint is the mark, so no conversation is judged twice; the run row carries
    the newest conversation time for the batch job's mark. An empty batch writes
    nothing, and a replayed batch replaces its own row.
    """

    spark = conversations.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if modality == "all" else batch.where(F.col("modality") == modality)
        fresh = stored(fresh, "fresh-conversations", spark)
        judged = turns_to_judge(fresh, log_around(spark, log_path, fresh, log_days))
        run_id = f"evr_stream_{batch_id:08d}"
        newest = fresh.agg(F.max("created_at").alias("created_at"), F.first(F.lit(run_id)).alias("run_id"))
        row = production_run(production_results(judged, run_id), modality).join(newest, "run_id")
        row = row.withColumn("git_sha", F.lit(git_sha))
        conform(row, EVAL_RUNS).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return (
        conversations.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
