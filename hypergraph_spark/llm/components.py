"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v, both BIGINT): root is the smallest node reachable.

    Self-loops are dropped, so an isolated node does not appear. Rounds go on until every component is a star around
    its smallest node. Each is two joins and is written to the shared folder; rounds grow with the logarithm of the largest component. No component is ever gathered in a task.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    pairs = materialize(pairs, "cc")
    for _ in range(most_rounds):
        if _stars(pairs):
            break
        # Large-star: every larger neighbour of a node points to the node's smallest neighbour.
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, F.col("a") == F.col("n")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        moved = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b"))
        pairs = materialize(moved.union(least.select("n", "low")).distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: no node has two smaller neighbours, or one and a larger one."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()
