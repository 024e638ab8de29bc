"""Session settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: safe to apply to a session somebody else built.
# Sizing (executors, memory, shuffle partitions) stays with the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state with timers needs this store; a running stream keeps the one it began with.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# Adaptive execution joins small shuffle partitions but never cuts large ones, so it starts
# from many: what a task reads is then bounded by the advisory size, however large the input.
INITIAL_PARTITIONS = 400
# Logs shrink more than tenfold in files; a split of this size is some hundred MB of rows to sort.
SPLIT_BYTES = 32 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    wanted = max(INITIAL_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if int(spark.conf.get(_INITIAL, "1")) < wanted:
        spark.conf.set(_INITIAL, str(wanted))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SPLIT)) > SPLIT_BYTES:
        spark.conf.set(_SPLIT, str(SPLIT_BYTES))
    return spark


def local_session(app: str, cpus: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several sinks read.

    Uses reliable checkpoint files in the folder named by ``spark.checkpoint.dir``,
    so a lost executor costs a re-read, not a recomputation. Only a session without
    that setting (a test) gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or "cluster" in context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnledger-ckpt-"))
    return df.checkpoint()


SCRATCH = "turnledger.scratch"


def scratch(spark: SparkSession) -> str:
    """The shared folder for stored intermediate tables, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own. What is
    stored there belongs to the session's owner and may go when its queries are written.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="turnledger-scratch-")
        spark.conf.set(SCRATCH, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Write a frame as a table in the scratch folder and read it back.

    Later plans see its true size and choose their joins by it; a lost executor costs a
    read, not a recomputation. ``reader`` is the session that goes on with it, by default
    the frame's own.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
