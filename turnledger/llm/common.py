"""What the operators share: scratch tables, words, slices of an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
OWN_FOLDER = "turnledger.llm.scratch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Slices of a hashed order: enough to spread one hot group over a large cluster, few
# enough that the table of slice totals stays small.
SLICE_BITS = 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get(OWN_FOLDER, None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set(OWN_FOLDER, folder)
    return folder.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a read, and gives the optimiser the
    true size of the frame for its choice of joins.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = 2000, mbytes: int = 16) -> None:
    """Bound the batches handed to Python by rows and by bytes: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mbytes << 20))


def text_of(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is many times faster than ``translate`` and does the same unless the text
    holds other letters with case.
    """
    other = F.regexp_like(text, F.lit(r"[[\p{IsUppercase}\p{Lt}]&&[^\x00-\x7F]]"))
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def slice_of(hashed: Column) -> Column:
    """The slice of a 64-bit hash in unsigned order: its leading bits."""
    return F.shiftrightunsigned(hashed, 64 - SLICE_BITS).cast("int")


def unsigned_order(hashed: Column) -> Column:
    """A signed hash whose order is the unsigned one: slices then follow each other."""
    return hashed.bitwiseXOR(F.lit(-(1 << 63)))


def one_of_each(df: DataFrame, keys: list[str], repeats: DataFrame) -> DataFrame:
    """The rows of ``df``, but a single one for each key that stands in ``repeats``.

    ``repeats`` holds the keys of more than one row, null being a key. Rows of other keys do
    not move. Of those of a key the one whose columns hash lowest stays, so reruns agree.
    """
    if repeats.isEmpty():
        return df
    again = repeats.select(*[F.col(k).alias(f"__again_{i}") for i, k in enumerate(keys)])
    met = [df[k].eqNullSafe(again[f"__again_{i}"]) for i, k in enumerate(keys)]
    whole = F.struct(*[F.col(c) for c in df.columns])
    place = F.struct(F.xxhash64(F.to_json(whole)), F.to_json(whole))
    single = df.join(again, met, "left_semi").groupBy(*keys).agg(F.min_by(whole, place).alias("__row"))
    return df.join(again, met, "left_anti").unionByName(single.select("__row.*"))
