"""Connected components of a graph given as an edge table, by alternating star contractions.

A large-star step hangs every larger neighbour of a node on the smallest node of its neighbourhood,
a small-star step does so with the smaller neighbours; both keep the components.  When nothing
changes any more the graph is a forest of stars whose centres are the smallest nodes.  Smallest
neighbours are aggregated before the shuffle and joined back, so that the neighbours of a node with
very many edges never meet in one task; each round is written as a stage table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """For edges with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.union(least.select("a", F.col("least").alias("b"))).where(F.col("a") != F.col("b"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any orderable type to (node, root): root is the smallest node of the component.

    Nodes without an edge do not appear; nulls and loops are left out, repeated edges count once.
    """
    current = edges.select("a", "b").where(F.col("a") != F.col("b"))
    current = materialize(
        current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name="edges"
    )
    state = _state(current)
    while True:
        current = materialize(_small_star(_large_star(current).distinct()).distinct(), name="edges")
        state, last = _state(current), state
        if state == last:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
