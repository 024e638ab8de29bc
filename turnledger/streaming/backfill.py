"""Backfill: a table's history sent through the stores and streams that live rows take.

Rows arrive as files in a folder. Every job starts in folders of its own, so one that is run
again after a failure starts over; inside a run the checkpoint of the stream holds its place.
What is returned is read back from the store that the job wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.schemas import EVAL_RUNS
from turnledger.session import scratch
from turnledger.sources.readers import CORRUPT, bad_rows, good_rows, read_trace_log
from turnledger.sources.sinks import write_log
from turnledger.streaming import evaluate, ingest
from turnledger.streaming.live import live_turn_stream

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def arrivals(df: DataFrame, root: str, by: str | None = None, batches: int = 1) -> DataFrame:
    """The rows as a stream of files: one micro-batch, or a micro-batch for each of ``batches``
    ranges of ``by``, in any order."""
    rows = df if by is None else df.repartitionByRange(batches, by)
    rows.write.parquet(f"{root}/arrivals")
    reader = df.sparkSession.readStream.schema(df.schema)
    return (reader if by is None else reader.option("maxFilesPerTrigger", 1)).parquet(f"{root}/arrivals")


def log_backfill(events: DataFrame, twice: Column, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(day log, lines set aside) after a transport that is not reliable.

    Events marked ``twice`` are delivered a second time; of those marked ``broken`` half a line
    arrives before the whole one. The log holds every event once, whatever the order. Lines
    repeat their field names and most of their payload, so they are sent compressed.
    """
    spark = events.sparkSession
    root = new_folder(spark, "log-backfill")
    line = F.to_json(F.struct(*events.columns), {"timestampFormat": MICROS})
    whole = events.select(line.alias("line"), twice.alias("twice"), broken.alias("broken"))
    half = F.substr("line", F.lit(1), F.floor(F.length("line") / 2).cast("int"))
    sent = F.array_compact(F.array(F.when(F.col("broken"), half), F.col("line"), F.when(F.col("twice"), F.col("line"))))
    whole.select(F.explode(sent).alias("value")).write.text(f"{root}/lines", compression="gzip")
    lines = read_trace_log(spark, f"{root}/lines", stream=True)
    ingest.append_log(ingest.deduplicated(good_rows(lines)), f"{root}/log", f"{root}/log-place").awaitTermination()
    aside = lines.writeStream.foreachBatch(ingest.batch_folder(f"{root}/aside", bad_rows))
    aside.option("checkpointLocation", f"{root}/aside-place").trigger(availableNow=True).start().awaitTermination()
    schema = events.schema.add("event_date", "date")
    log = spark.read.schema(schema).parquet(f"{root}/log")
    return log, spark.read.schema(f"{CORRUPT} string").parquet(f"{root}/aside")


def summary_backfill(log: DataFrame, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """The summary of every trace, from a levelled store that merged ``batches`` batches."""
    spark = log.sparkSession
    root = new_folder(spark, "summary-backfill")
    stream = arrivals(log, root, "created_at", batches)
    ingest.upsert_summaries(stream, f"{root}/store", f"{root}/place", fan_in).awaitTermination()
    return ingest.current_summaries(spark, f"{root}/store")


def outcome_backfill(summaries: DataFrame, width: str = "1 hour", lateness: str = ingest.LATENESS) -> DataFrame:
    """Outcome counts of the windows that the watermark has closed."""
    spark = summaries.sparkSession
    root = new_folder(spark, "outcome-backfill")
    rows = summaries.select("created_at", "modality", "outcome")
    closed = ingest.rolling_outcomes(arrivals(rows, root), width, lateness)
    query = closed.writeStream.format("parquet").option("path", f"{root}/windows")
    query.option("checkpointLocation", f"{root}/place").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{root}/windows")


def evaluation_backfill(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """The run row of a history that was judged as one batch of new conversations."""
    spark = conversations.sparkSession
    root = new_folder(spark, "evaluation-backfill")
    write_log(events, f"{root}/log")
    stream = arrivals(conversations, root)
    evaluate.evaluate_stream(stream, f"{root}/log", f"{root}/runs", f"{root}/place").awaitTermination()
    return spark.read.schema(EVAL_RUNS).parquet(f"{root}/runs/batch_id=*")


def live_backfill(fragments: DataFrame, lateness: str = ingest.LATENESS) -> DataFrame:
    """The log rows of live sessions, put together by the keyed stream.

    The history is one micro-batch, so none of it is late. Then the clock closes the sessions
    whose ceiling lies before the watermark; those of the last minutes stay open.
    """
    spark = fragments.sparkSession
    root = new_folder(spark, "live-backfill")
    rows = live_turn_stream(arrivals(fragments, root), lateness=lateness)
    query = rows.writeStream.format("parquet").option("path", f"{root}/turns")
    query.option("checkpointLocation", f"{root}/place").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/turns")
