"""Cleaning edge lines and filtering graphs by degree; sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.operators.embed import durable
from hypergraph_spark.operators.stats import bfs, largest_component
from hypergraph_spark.plans.graph import HyperGraph, adjacency, graph_from_lines, half_adjacency, half_degrees


def _tokens(c: str = "value") -> Column:
    return F.filter(F.split(F.col(c), r"\s+"), lambda x: x != "")


def clean_lines(lines: DataFrame, remove_self_loops: bool = True, deduplicate: bool = True, min_degree: int | None = None, max_degree: int | None = None) -> DataFrame:
    """Lines stripped, without two-token self-loops, one of each sorted token multiset (the smallest text), degree-filtered."""
    out = lines.select(F.btrim("value", F.lit(" \t\r\n")).alias("value")).where(F.length("value") > 0).withColumn("t", _tokens())
    if remove_self_loops:
        out = out.where(~((F.size("t") == 2) & (F.col("t")[0] == F.col("t")[1])))
    if deduplicate:
        out = out.groupBy(F.array_sort("t").alias("k")).agg(F.min("value").alias("value"))
    out = out.select("value")
    return out if min_degree is None and max_degree is None else filter_lines_by_degree(out, min_degree, max_degree)


def filter_lines_by_degree(lines: DataFrame, min_degree: int | None = None, max_degree: int | None = None) -> DataFrame:
    """Lines all of whose tokens occur between min and max times over all lines (one pass)."""
    deg = lines.select(F.explode(_tokens()).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("d"))
    low = F.col("d") < (min_degree if min_degree is not None else 0)
    high = F.col("d") > (max_degree if max_degree is not None else 2**62)
    bad = deg.where(low | high).select("e")
    gone = lines.select("value", F.explode(_tokens()).alias("e")).join(bad, "e", "left_semi").select("value").distinct()
    return lines.select("value").join(gone, "value", "left_anti")


def filter_graph_by_degree(graph: HyperGraph, min_degree: int | None = None, max_degree: int | None = None) -> DataFrame:
    """(src, dst), src < dst, of the edges between entities whose degree lies in range."""
    half = durable(half_adjacency(graph), "adj")
    d = half_degrees(half)
    ok = durable(d.where((F.col("d") >= (min_degree or 0)) & (F.col("d") <= (max_degree if max_degree is not None else 2**62))).select("src"), "ok")
    return half.join(ok, "src", "left_semi").join(ok.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def largest_connected_component(graph: HyperGraph, columns: str = "complex::reflexive::node", trim_n: int = 16) -> HyperGraph:
    """The largest component as a graph of its own; a single entity becomes a self-edge."""
    nodes = durable(largest_component(graph), "lcc")
    inside = adjacency(graph).where(F.col("src") < F.col("dst")).join(nodes.withColumnRenamed("entity_id", "src"), "src", "left_semi")
    lines = inside.select(F.concat_ws(" ", "src", "dst").alias("value"))
    if lines.isEmpty():
        lines = nodes.select(F.concat_ws(" ", "entity_id", "entity_id").alias("value"))
    return graph_from_lines(lines, columns, trim_n)


# --- sampling: all draws order by a hash of the seed and the key, so reruns and partitionings agree ---------------


def _draw(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def _induced(graph: HyperGraph, nodes: DataFrame) -> DataFrame:
    s, d = nodes.select(F.col("entity_id").alias("src")), nodes.select(F.col("entity_id").alias("dst"))
    return graph.edges.where(F.col("src") != F.col("dst")).select("src", "dst").join(s, "src", "left_semi").join(d, "dst", "left_semi")


def sample_nodes(graph: HyperGraph, num_nodes: int, seed: int = 42) -> DataFrame:
    return graph.entities.select("entity_id").orderBy(_draw(seed, "entity_id"), "entity_id").limit(num_nodes)


def sample_edges(graph: HyperGraph, num_edges: int, seed: int = 42) -> DataFrame:
    """Undirected edges without replacement."""
    return graph.edges.where(F.col("src") < F.col("dst")).select("src", "dst").orderBy(_draw(seed, "src", "dst"), "src", "dst").limit(num_edges)


def sample_neighborhood(graph: HyperGraph, seeds: DataFrame, num_hops: int = 2, max_neighbors: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced directed edges) within num_hops of known seeds, at most max_neighbors new ones per entity and hop."""
    adj = adjacency(graph)
    nodes = durable(graph.entities.join(seeds.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id"), "hop")
    front = nodes
    for hop in range(num_hops):
        step = front.join(adj, F.col("entity_id") == F.col("src")).select("src", "dst")
        if max_neighbors is not None:
            rank = F.row_number().over(Window.partitionBy("src").orderBy(_draw(seed + hop, "src", "dst"), "dst"))
            step = step.withColumn("k", rank).where(F.col("k") <= max_neighbors)
        front = durable(step.select(F.col("dst").alias("entity_id")).distinct().join(nodes, "entity_id", "left_anti"), "hop")
        nodes = durable(nodes.unionByName(front), "hop")
    return nodes, _induced(graph, nodes)


def sample_subgraph(graph: HyperGraph, num_nodes: int, method: str = "random_walk", walk_length: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges): random_node, bfs from a drawn entity, or the first entities that random walks meet."""
    if method == "random_node":
        nodes = sample_nodes(graph, num_nodes, seed)
    elif method == "bfs":
        nodes = bfs(adjacency(graph), sample_nodes(graph, 1, seed)).orderBy("hops", _draw(seed, "entity_id")).limit(num_nodes).select("entity_id")
    elif method == "random_walk":
        from hypergraph_spark.operators.algorithms import random_walks

        start = sample_nodes(graph, 10, seed)
        walks = random_walks(graph, 1, walk_length, seed=seed).where(F.col("path")[0].isNotNull()).join(start.select(F.col("entity_id").alias("first")), F.col("path")[0] == F.col("first"), "left_semi")
        met = walks.select(F.posexplode("path").alias("i", "entity_id")).groupBy("entity_id").agg(F.min("i").alias("i"))
        nodes = met.orderBy("i", _draw(seed, "entity_id")).limit(num_nodes).select("entity_id")
    else:
        raise ValueError(f"unknown method {method!r}")
    nodes = durable(nodes, "sample")
    return nodes, _induced(graph, nodes)


def graphsaint_sample(graph: HyperGraph, batch_size: int = 512, walk_length: int = 4, num_batches: int = 5, seed: int = 42) -> DataFrame:
    """(batch, src, dst): induced edges of num_batches sets of entities met by batch_size short walks; all batches in one plan."""
    from hypergraph_spark.operators.algorithms import random_walks

    walks = random_walks(graph, num_batches, walk_length + 1, seed=seed)
    walks = walks.withColumn("r", F.row_number().over(Window.partitionBy(F.col("path")[0]).orderBy("walk")) - 1)
    rank = F.row_number().over(Window.partitionBy("r").orderBy(_draw(seed, "walk")))
    nodes = walks.withColumn("k", rank).where(F.col("k") <= batch_size).select(F.col("r").alias("batch"), F.explode("path").alias("entity_id")).distinct()
    e = graph.edges.where(F.col("src") != F.col("dst")).select("src", "dst")
    return e.join(nodes.withColumnRenamed("entity_id", "src"), "src").join(nodes.withColumnRenamed("entity_id", "dst"), ["batch", "dst"]).select("batch", "src", "dst")


def negative_sampling(graph: HyperGraph, num_negatives: int = 1000, seed: int = 42) -> DataFrame:
    """(src, dst): distinct ordered non-edges, from up to 20 times as many drawn pairs."""
    ix = durable(graph.index(), "ix")
    n = ix.count()
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(max(1, n)))
    drawn = ix.sparkSession.range(20 * num_negatives).select("id", u(1).alias("i"), u(2).alias("j")).where(F.col("i") != F.col("j"))
    drawn = drawn.groupBy("i", "j").agg(F.min("id").alias("id"))
    named = drawn.join(ix.select(F.col("idx").alias("i"), F.col("entity_id").alias("src")), "i").join(ix.select(F.col("idx").alias("j"), F.col("entity_id").alias("dst")), "j")
    return named.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti").orderBy("id").limit(num_negatives).select("src", "dst")


def train_test_split_edges(graph: HyperGraph, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """(src, dst, part): undirected edges in hashed order, the first int(m (1 - ratio)) are train.

    The cut is found from bucket counts, so no task orders all edges.
    """
    e = durable(half_adjacency(graph), "adj").withColumn("u", _draw(seed, "src", "dst")).withColumn("b", F.shiftrightunsigned("u", 52))
    e = e.withColumn("u", F.col("u").bitwiseAND((1 << 52) - 1))
    counts = e.groupBy("b").agg(F.count(F.lit(1)).alias("n"))  # 4096 buckets
    w = Window.orderBy("b")
    total = counts.agg(F.sum("n").alias("m"))
    offsets = counts.withColumn("before", F.sum("n").over(w) - F.col("n")).crossJoin(total)
    rank = F.row_number().over(Window.partitionBy("b").orderBy("u", "src", "dst"))
    out = e.withColumn("k", rank).join(F.broadcast(offsets.select("b", "before", "m")), "b")
    train = F.col("before") + F.col("k") <= F.floor(F.col("m") * (1 - test_ratio))
    return out.select("src", "dst", F.when(train, "train").otherwise("test").alias("part"))
