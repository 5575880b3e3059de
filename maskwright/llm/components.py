"""Connected components by alternating large-star and small-star steps.

The edge table stays distributed; every round is two grouped minima and two joins, so no node's
neighbours are gathered in one place. (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b; returns edges of the same form, each once."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least, "a").withColumn("least", F.least("least", "a"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            joined.select("a", F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node of its component.

    Edges may be given in either direction, repeatedly, and from a node to itself (those name no
    link and are ignored). Nodes are compared by Spark's order, so longs and structs both work.
    Nulls link nothing. An empty table gives an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = cut(edges.distinct())
    for _ in range(most_rounds):
        # Stars are done when no node is linked to two nodes and no centre is linked further down.
        after = cut(_star(_star(edges, large=True), large=False))
        fan = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chain = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi")
        edges = after
        if fan.isEmpty() and chain.isEmpty():
            break
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
