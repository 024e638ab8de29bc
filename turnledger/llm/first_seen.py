"""Which of equal pieces of text came first, for pieces from all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import store, text_of


def slim_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text): ``tag`` tells rows apart that share an identifier but not a text."""
    text = text_of(text_col)
    tag = F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))
    return df.select(
        F.col(id_col).cast("long").alias("id"), tag.alias("tag"), text.alias("text")
    )


def place(start: str, tag: str) -> Column:
    """Where a piece starts and the tag of its row in one number, in this order."""
    return F.shiftleft(F.col(start).cast("long"), 31).bitwiseOR(F.col(tag))


def start_of(where: str | Column) -> Column:
    return F.shiftright(where, 31)


def tag_of(where: str | Column) -> Column:
    return F.col(where).bitwiseAND(F.lit((1 << 31) - 1))


def order(id_col: str = "id", where: str = "where") -> Column:
    """Documents by identifier, null first, then by start: what "earlier" means.

    A null sorts below every identifier inside a struct, in a minimum too.
    """
    return F.struct(F.col(id_col).alias("id"), F.col(where).alias("where"))


def repeated(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key occurs more than once.

    Counting combines before the shuffle, so a key that stands everywhere costs a row per
    task; the join that follows can be split where a key is hot.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return rows.join(store(counts.select(key), name), key, "left_semi")
