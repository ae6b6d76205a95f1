"""Connected components of an undirected graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import written


def star_forest(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) but the smallest of each component, with that one.

    Alternates two contractions until nothing changes: every larger neighbour is linked to
    the smallest neighbour, then every smaller one is. A component becomes a star around its
    smallest node in a number of rounds that grows with the logarithm of its size. A node's
    minimum is a combined aggregate and is written before it is joined to the node's edges,
    so that a node with very many edges is split among tasks.
    """
    current = written(oriented(edges, "a", "b"), "edges")
    state = mark(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = written(
            both.groupBy(F.col("high").alias("node")).agg(F.least(F.min("low"), F.first("high")).alias("least")),
            "least",
        )
        large = both.join(least, F.col("high") == F.col("node")).where("low > high")
        large = written(oriented(large, "low", "least"), "large")
        least = written(large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least")), "least")
        small = large.join(least, F.col("high") == F.col("node"))
        low = F.explode(F.array_distinct(F.array("high", "low")))
        current = written(
            oriented(small.select(low.alias("each"), "least"), "each", "least"), "edges"
        )
        before, state = state, mark(current)
        if state == before:
            break
    return current.select(F.col("high").alias("node"), F.col("low").alias("root"))


def oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (high, low) without loops."""
    return (
        edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .where("high <> low")
        .distinct()
    )


def mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum over them: equal exactly when nothing changed, but for chance."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("high", "low").cast("decimal(20,0)")).alias("sum"),
    ).first()
    return row["n"], row["sum"]
