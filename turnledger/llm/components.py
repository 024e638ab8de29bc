"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b); equal roots, same component.

    In each round every node moves to its least neighbour or stays, and the edges move with
    their ends until none is left. Least means by value in even rounds, which folds a star
    at once, and by a hash in odd rounds, which halves any long chain. Neighbours meet in a
    minimum, which is combined before the shuffle, so a node may have any number of edges.
    """
    edges = store(edges.filter("a != b").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        n = len(moves)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if n % 2 == 0:
            to = F.least(F.min("b"), F.col("a"))
        else:
            rank = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("rank"), F.col(c).alias("v"))  # noqa: B023, E731
            to = F.least(F.min(rank("b")), F.first(rank("a")))["v"]
        moved = store(both.groupBy("a").agg(to.alias("to")).withColumnRenamed("a", "node"), "moves")
        moves.append(moved)
        ends = moved.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        left = edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("a_to")), "a")
        edges = left.join(ends, "b").filter("a_to != b_to")
        pair = (F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = store(edges.select(*pair).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].withColumnRenamed("to", "root")
    for moved in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = moved.join(later, "to", "left").select(
            "node", F.coalesce("root", "to").alias("root")
        )
    return roots
