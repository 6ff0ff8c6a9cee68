"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged


def _large_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Every larger neighbour of a node now hangs on the least of the node and its neighbours; ``made`` gets the tables staged on the way."""
    both = staged(edges.union(edges.select("b", "a")).distinct(), "both")
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    made += [both, least]
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """A node and its smaller neighbours now hang on the least of them."""
    down = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "down")
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    made += [down, least]
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but the roots; a root is its component's least node.

    Self loops, repeated edges and either direction are fine; no edges, no rows.
    The number of rounds grows with the logarithm of the number of nodes; each
    is written to the shared folder, so a lost executor costs the round's tasks that it held.
    The end is a round that leaves the count and the sum of hashes of all edges as they were.
    """
    now = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    state = None
    while True:
        made = [now]
        now = staged(_small_star(_large_star(now, made), made), "edges")
        released(edges.sparkSession, *made)
        state, before = _state(now), state
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
