"""Random graphs as edge DataFrames (src, dst) and labels (entity_id, label). Draws are hashes of the seed and the pair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(seed: int, *cols: str) -> Column:
    """A uniform number in [0, 1) of the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(2**53)) / float(2**53)


def _pairs(spark: SparkSession, n: int, directed: bool = False) -> DataFrame:
    """All node pairs, generated row by row from the first node: what is asked for is every pair, each then drawn."""
    i = spark.range(n).withColumnRenamed("id", "i")
    if directed:
        return i.select("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).where(F.col("i") != F.col("j"))
    return i.where(F.col("i") < n - 1).select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1))).alias("j"))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst"))


def erdos_renyi(spark: SparkSession, num_nodes: int, p: float = 0.1, seed: int = 42, directed: bool = False) -> DataFrame:
    return _named(_pairs(spark, num_nodes, directed).where(_u(seed, "i", "j") < p))


def stochastic_block_model(spark: SparkSession, block_sizes: list[int], p_within: float = 0.3, p_between: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): a node's label is its block."""
    ends = np.cumsum(block_sizes).tolist()
    block = lambda c: F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col(c)))
    p = F.when(block("i") == block("j"), p_within).otherwise(p_between)
    edges = _named(_pairs(spark, ends[-1]).where(_u(seed, "i", "j") < p))
    labels = spark.range(ends[-1]).select(F.col("id").cast("string").alias("entity_id"), block("id").alias("label"))
    return edges, labels


def planted_partition(spark: SparkSession, num_communities: int = 4, community_size: int = 25, p_in: float = 0.3, p_out: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return stochastic_block_model(spark, [community_size] * num_communities, p_in, p_out, seed)


def barabasi_albert(spark: SparkSession, num_nodes: int, m: int = 3, seed: int = 42) -> DataFrame:
    """A clique of m + 1 nodes, then m distinct ends each, drawn by degree. Every node depends on those before, so on the driver."""
    if num_nodes <= m:
        raise ValueError("num_nodes must exceed m")
    rng = np.random.default_rng(seed)
    edges = [(i, j) for i in range(m + 1) for j in range(i)]
    ends = [x for e in edges for x in e]
    for v in range(m + 1, num_nodes):
        to: set[int] = set()
        while len(to) < m:
            to.add(ends[int(rng.integers(len(ends)))])
        for t in sorted(to):
            edges.append((v, t))
            ends += [v, t]
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")


def watts_strogatz(spark: SparkSession, num_nodes: int, k: int = 6, beta: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges, labels i % 4): a ring of k // 2 neighbours a side; each edge moves its far end with probability beta."""
    ring = spark.range(num_nodes).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("s"))
    far = F.pmod(F.col("i") + F.col("s"), F.lit(num_nodes))
    other = F.pmod(F.col("i") + 1 + F.floor(_u(seed + 1, "i", "s") * (num_nodes - 1)), F.lit(num_nodes))
    e = ring.select("i", F.when(_u(seed, "i", "s") < beta, other).otherwise(far).alias("j")).where(F.col("i") != F.col("j"))
    e = e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return _named(e), spark.range(num_nodes).select(F.col("id").cast("string").alias("entity_id"), F.pmod("id", F.lit(4)).cast("int").alias("label"))


def community_graph(spark: SparkSession, num_nodes: int, num_edges: int, num_classes: int, intra: float = 0.7, seed: int = 42, feature_dim: int = 0) -> dict:
    """A synthetic labelled graph: num_edges draws, `intra` of them inside the first node's class; features are noise plus 2 in the class's place."""
    d = spark.range(num_edges).withColumn("i", F.floor(_u(seed, "id") * num_nodes))
    inside = F.pmod(F.col("i"), F.lit(num_classes)) + num_classes * F.floor(_u(seed + 1, "id") * ((num_nodes + num_classes - 1) // num_classes))
    j = F.when(_u(seed + 2, "id") < intra, F.pmod(inside, F.lit(num_nodes))).otherwise(F.floor(_u(seed + 3, "id") * num_nodes))
    e = d.withColumn("j", j).where(F.col("i") != F.col("j")).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    labels = spark.range(num_nodes).select(F.col("id").cast("string").alias("entity_id"), F.pmod("id", F.lit(num_classes)).cast("int").alias("label"))
    out = {"edges": _named(e), "labels": labels, "num_nodes": num_nodes, "num_classes": num_classes, "columns": "complex::reflexive::node"}
    if feature_dim:
        k = F.sequence(F.lit(0), F.lit(feature_dim - 1))
        v = F.transform(k, lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col("entity_id"), t), F.lit(2**20)) / float(2**20) - 0.5 + F.when(t == F.col("label"), 2.0).otherwise(0.0))
        out["features"] = labels.select("entity_id", v.alias("v"))
    return out
