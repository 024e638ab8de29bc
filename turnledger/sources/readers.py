"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.schemas import LABELLED_SET, QUERY_RESULTS, TABLES, TRACE_EVENTS
from turnledger.sources.listing import partition_values, read_manifest

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_label_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Labelled queries from JSON lines. Blank lines are skipped, a missing path raises.

    ``limit`` takes the first queries by id, for a smoke run.
    """
    rows = spark.read.schema(LABELLED_SET).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.orderBy("query_id").limit(limit)


_RUN_RESULTS = T.StructType([*QUERY_RESULTS.fields, T.StructField("run_id", T.StringType())])


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Per-query results of all runs; ``run_id`` is the partition column."""
    return spark.read.schema(_RUN_RESULTS).option("basePath", root).json(f"{root}/run_id=*/")


def read_latest_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of the greatest run id, which is found among the names of the runs' folders;
    no other run's files are opened."""
    runs = partition_values(spark, root, "run_id")
    if not runs:
        return spark.createDataFrame([], _RUN_RESULTS)
    return spark.read.schema(_RUN_RESULTS).option("basePath", root).json(f"{root}/run_id={runs[-1]}")


def read_log_days(spark: SparkSession, root: str, first: date, last: date, schema: T.StructType = TRACE_EVENTS) -> DataFrame:
    """The rows of a day-partitioned log from the first to the last day. Only the folders of
    those days are listed and read."""
    days = [d for d in partition_values(spark, root, "event_date") if first.isoformat() <= d <= last.isoformat()]
    if not days:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/event_date={d}" for d in days])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as the newest completed load left it."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/{read_manifest(spark, root).entries[name]}")


def contract_breaks(line: Column, schema: T.StructType) -> Column:
    """How a JSON record breaks a closed schema: ``not_an_object``, ``missing:f``, ``type:f`` and
    ``extra:f``, in this order; a schema says which fields may be null, and no other field
    may stand there."""
    keys = F.json_object_keys(line)
    parsed = F.from_json(line, T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
    raw = {f.name: F.get_json_object(line, f"$['{f.name}']") for f in schema.fields}
    missing = [F.when(raw[f.name].isNull(), F.lit(f"missing:{f.name}")) for f in schema.fields if not f.nullable]
    wrong = [
        F.when(raw[f.name].isNotNull() & parsed[f.name].isNull(), F.lit(f"type:{f.name}")) for f in schema.fields
    ]
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("extra:"), k))
    found = F.concat(F.array_compact(F.array(*missing, *wrong)), extra)
    return F.when(keys.isNull(), F.array(F.lit("not_an_object"))).otherwise(found)


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines held to a closed schema: ``line``, the parsed ``record`` and its
    ``violations``; nothing is dropped and no line fails the read."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(
        F.col("value").alias("line"),
        F.from_json("value", schema).alias("record"),
        contract_breaks(F.col("value"), schema).alias("violations"),
    )


def read_fixture(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document or list held to its schema; a wrong type fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_trace_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Trace rows as JSON lines, batch or stream. Rows that do not parse keep their
    text in ``_corrupt_record`` so they can be set aside, not lost."""
    reader = spark.readStream if stream else spark.read
    return (
        reader.schema(_with_corrupt(TRACE_EVENTS))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def good_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col(CORRUPT).isNull() & F.col("event_id").isNotNull()).drop(CORRUPT)


def bad_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col(CORRUPT).isNotNull() | F.col("event_id").isNull())
