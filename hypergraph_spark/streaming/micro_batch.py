"""Graphs kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hypergraph_spark.operators.embed import durable, embed_inductive
from hypergraph_spark.plans.graph import HyperGraph, build_graph, with_weights
from hypergraph_spark.sources.lines import hyperedges


class IncrementalGraph:
    """Sums per pair and per entity under micro-batches of lines: additive as long as no hyperedge is trimmed.

    add() merges a batch's sums into the stored ones, each state written to the shared folder, so a batch costs its
    own expansion and one merge, not a rebuild.
    """

    def __init__(self, columns: str):
        self.columns = columns
        self.edges: DataFrame | None = None
        self.entities: DataFrame | None = None

    def add(self, lines: DataFrame) -> HyperGraph:
        part = build_graph(hyperedges(lines, self.columns), self.columns, trim_n=0)
        e, n = part.edges.select("src", "dst", "value"), part.entities
        if self.edges is not None:
            e = self.edges.unionByName(e).groupBy("src", "dst").agg(F.sum("value").alias("value"))
            n = self.entities.unionByName(n).groupBy("entity_id").agg(F.min("column_id").alias("column_id"), F.sum("row_sum").alias("row_sum"))
        self.edges, self.entities = durable(e, "stream-edges"), durable(n, "stream-entities")
        return self.graph()

    def graph(self) -> HyperGraph:
        return HyperGraph(self.entities, with_weights(self.edges, self.entities), self.columns)


def stream_graph(lines: DataFrame, columns: str, checkpoint: str, on_batch: Callable[[HyperGraph, int], None] | None = None) -> tuple[StreamingQuery, IncrementalGraph]:
    """Runs an IncrementalGraph over a streaming DataFrame of lines (value)."""
    state = IncrementalGraph(columns)

    def batch(df: DataFrame, number: int) -> None:
        graph = state.add(df)
        if on_batch:
            on_batch(graph, number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start(), state


def embed_streaming(batches: list[DataFrame], columns: str, feature_dim: int = 256, num_iterations: int = 40, callback: Callable[[int, DataFrame], None] | None = None, **options) -> tuple[HyperGraph, DataFrame]:
    """Batch by batch: append the lines, start known entities from their vectors, embed."""
    if not batches:
        raise ValueError("no batch given")
    from hypergraph_spark.operators.embed import embed
    from hypergraph_spark.plans.graph import graph_from_lines

    seen = batches[0].select("value")
    graph = graph_from_lines(seen, columns)
    emb = embed(graph, feature_dim, num_iterations, **options)
    for i, b in enumerate(batches):
        if i:
            graph, emb = embed_inductive(emb, seen, b, columns, num_iterations, **options)
            seen = seen.unionByName(b.select("value"))
        if callback:
            callback(i, emb)
    return graph, emb


def windowed_edges(events: DataFrame, time: str, window: str, left: str, right: str, watermark: str | None = None) -> DataFrame:
    """(window_start, src, dst, n): events joining two columns' values, counted per time window; batch or streaming."""
    if watermark:
        events = events.withWatermark(time, watermark)
    g = events.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.window(time, window).alias("w"), F.col(left).cast("string").alias("src"), F.col(right).cast("string").alias("dst"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "src", "dst", "n")
