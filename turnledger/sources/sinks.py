"""Writers. Appends and reloads keep to the table schema, never to an inferred one."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.plans.clusters import cluster_documents
from turnledger.plans.evaluation import journey_counts, run_rows
from turnledger.plans.traces import load_counts
from turnledger.schemas import EVAL_RUNS, TABLES, Policy
from turnledger.session import durable
from turnledger.sources.listing import Manifest, commit, read_manifest, vacuum
from turnledger.sources.readers import read_table


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns and types; absent nullable columns become null."""
    have = set(df.columns)
    required = [f.name for f in schema.fields if not f.nullable and f.name not in have]
    if required:
        raise ValueError(f"missing required columns: {required}")
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run rows. A run has a folder of its own, so a retry replaces what it wrote."""
    rows = conform(runs, EVAL_RUNS).withColumn("run", F.col("run_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def load_ndjson(spark: SparkSession, source: str, schema: T.StructType, path: str) -> None:
    spark.read.schema(schema).option("mode", "FAILFAST").json(source).write.mode("append").parquet(path)


def reload_tables(frames: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Replace all tables in one step and return the row counts of what was stored.

    Every table is written to a folder of its own first; one manifest then names the new
    folders. A load that fails anywhere leaves all tables as they were, tables that are not
    in ``frames`` stay, and the load before the last can still be read.
    """
    spark = next(iter(frames.values())).sparkSession
    before = read_manifest(spark, root)
    load = f"load-{uuid.uuid4().hex}"
    for name, df in frames.items():
        conform(df, TABLES[name]).write.parquet(f"{root}/{name}/{load}")
    entries = before.entries | dict.fromkeys(frames, load)
    commit(spark, root, before, entries)
    used = {f"{root}/{n}": {m.entries[n] for m in (before, Manifest(0, entries)) if n in m.entries} for n in entries}
    vacuum(spark, root, used)
    return load_counts({name: read_table(spark, root, name) for name in frames})


def write_log(events: DataFrame, path: str) -> None:
    """Store trace rows by day, so that a cutoff prunes folders."""
    (
        events.withColumn("event_date", F.to_date("timestamp"))
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def write_run(results: DataFrame, run_meta: Mapping[str, object], root: str) -> None:
    """Per-query rows, run summary and failure analysis of a scored run.

    Three sinks read the results, so their lineage is cut once.
    """
    results = durable(results)
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{root}/results")
    summary = journey_counts(run_rows(results, ["run_id"])).select(
        "*", *[F.lit(v).alias(k) for k, v in run_meta.items()]
    )
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{root}/summaries")
    cluster_documents(results).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id"
    ).json(f"{root}/clusters")


def policy_hash(policy: Policy) -> str:
    """A stable hash of the thresholds a run was made with."""
    text = json.dumps(asdict(policy), sort_keys=True)
    return "cfg_" + hashlib.sha256(text.encode()).hexdigest()[:12]


def write_label_set(labelled: DataFrame, path: str) -> None:
    labelled.write.mode("overwrite").json(path)
