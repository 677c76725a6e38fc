"""Heterogeneous graphs: typed nodes and edges, per-relation and metapath embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.operators import linalg as la
from hypergraph_spark.operators.embed import embed
from hypergraph_spark.plans.graph import HyperGraph, graph_from_lines

NODE = "complex::reflexive::node"
#: The next ends of an entity that travel in one row of a metapath step, about.
LIST_ENDS = 1024


class HeteroGraph:
    """Edge DataFrames (src, dst) by edge type; an entity is `type_id`."""

    def __init__(self) -> None:
        self.edges: dict[str, tuple[str, str, DataFrame]] = {}
        self.raw: dict[str, DataFrame] = {}
        self.given: dict[str, DataFrame] = {}
        self.features: dict[str, DataFrame] = {}
        self.bare: set[str] = set()

    def add_node_type(self, name: str, features: DataFrame | None = None) -> HeteroGraph:
        """Register a node type; features, if any, has a row per node and then decides num_nodes."""
        self.bare.add(name)
        return self if features is None else self.add_features(name, features)

    def add_edge_type(self, name: str, src_type: str, dst_type: str, edges: DataFrame) -> HeteroGraph:
        named = edges.select(F.concat_ws("_", F.lit(src_type), F.col("src").cast("string")).alias("src"), F.concat_ws("_", F.lit(dst_type), F.col("dst").cast("string")).alias("dst"))
        self.edges[name] = (src_type, dst_type, named)
        self.given[name] = edges.select("src", "dst")
        self.raw[name] = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        return self

    def add_features(self, node_type: str, features: DataFrame) -> HeteroGraph:
        self.features[node_type] = features
        return self

    @property
    def node_types(self) -> list[str]:
        return sorted({t for s, d, _ in self.edges.values() for t in (s, d)} | set(self.features) | self.bare)

    @property
    def edge_types(self) -> list[str]:
        return list(self.edges)

    def get_edges(self, edge_type: str) -> DataFrame:
        """(src, dst) of an edge type, ids as they were given."""
        if edge_type not in self.raw:
            raise ValueError(f"unknown edge type {edge_type!r}")
        return self.raw[edge_type]

    def nodes(self, node_type: str) -> DataFrame:
        parts = [e.select(F.col(c).alias("entity_id")) for s, d, e in self.edges.values() for c, t in (("src", s), ("dst", d)) if t == node_type]
        if not parts and node_type in self.bare:
            return next(iter(self.edges.values()))[2].select(F.col("src").alias("entity_id")).limit(0)
        if not parts:
            raise ValueError(f"unknown node type {node_type!r}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def num_nodes(self, node_type: str | None = None) -> int:
        """Nodes of a type - rows of its features, else distinct ends of edges - or of all types."""
        if node_type is None:
            return sum(self.num_nodes(t) for t in self.node_types)
        return self.features[node_type].count() if node_type in self.features else self.nodes(node_type).count()

    def num_edges(self, edge_type: str | None = None) -> int:
        """Pairs of an edge type, or of all; repeats count."""
        return sum(self.get_edges(t).count() for t in ([edge_type] if edge_type else self.edge_types))

    def homogeneous_edges(self) -> DataFrame:
        """(src, dst) of all edge types; ids are `type_id` if there is more than one node type, else as given."""
        parts = [e for _, _, e in self.edges.values()] if len(self.node_types) > 1 else list(self.raw.values())
        if not parts:
            raise ValueError("the graph has no edge type")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def summary(self) -> str:
        rows = [f"node type {t}: {self.num_nodes(t)} nodes" for t in self.node_types]
        rows += [f"edge type {name}: {s} -> {d}, {self.num_edges(name)} edges" for name, (s, d, _) in self.edges.items()]
        return "\n".join([repr(self), *rows])

    def __repr__(self) -> str:
        return f"HeteroGraph(node_types={self.node_types}, edge_types={self.edge_types})"

    def relation_graph(self, edge_type: str, trim_n: int = 16) -> HyperGraph:
        return graph_from_lines(self.edges[edge_type][2].select(F.concat_ws(" ", "src", "dst").alias("value")), NODE, trim_n)

    def homogeneous(self, trim_n: int = 16) -> HyperGraph:
        return graph_from_lines(self.homogeneous_edges().select(F.concat_ws(" ", "src", "dst").alias("value")), NODE, trim_n)

    def embed_per_relation(self, feature_dim: int = 256, num_iterations: int = 40, combine: str = "concat", **options) -> DataFrame:
        """One embedding per edge type, side by side (zeros where an entity lacks a type) or averaged over those present; l2 rows."""
        if combine not in ("concat", "mean"):
            raise ValueError(f"unknown combine {combine!r}")
        out, k = None, 0
        for name in self.edges:
            x = embed(self.relation_graph(name), feature_dim, num_iterations, **options).select("entity_id", F.col("v").alias(f"v{k}"))
            out = x if out is None else out.join(x, "entity_id", "full_outer")
            k += 1
        zero = F.array_repeat(F.lit(0.0), feature_dim)
        cols = [F.coalesce(F.col(f"v{i}"), zero) for i in range(k)]
        if combine == "concat":
            return la.normalize(out.select("entity_id", F.concat(*cols).alias("v")), "l2")
        total = cols[0]
        for c in cols[1:]:
            total = F.zip_with(total, c, lambda x, y: x + y)
        n = sum((F.col(f"v{i}").isNotNull().cast("double") for i in range(1, k)), F.col("v0").isNotNull().cast("double"))
        return la.normalize(out.select("entity_id", total.alias("t"), n.alias("n")).select("entity_id", F.transform("t", lambda x: x / F.col("n")).alias("v")), "l2")

    def metapath_pairs(self, metapath: list[str]) -> DataFrame:
        """(src, dst): distinct ends of paths along the edge types, self-pairs left out; ends are made distinct at every step.

        A step joins each pair with whole lists of next ends, as given and not by name, and deals these by src before it
        takes them apart, so that lists travel and pairs are made distinct where they arrive. Long lists are cut into parts
        of LIST_ENDS by a hash of the end, which a long src is dealt by as well.
        """
        if len(metapath) < 2 or any(m not in self.edges for m in metapath):
            raise ValueError("a metapath has two or more known edge types")
        ends = [self.edges[m] for m in metapath]
        out, *steps = [self._typed(m) for m in metapath]
        fits = [a.schema["dst"].dataType == b.schema["src"].dataType for a, b in zip([out, *steps], steps, strict=False)]
        if not all(fits) or any(a[1] != b[0] for a, b in zip(ends, ends[1:], strict=False)):  # names are what such ends have in common
            out, *steps = [e for _, _, e in ends]
        named = out is ends[0][2]
        out = out.distinct()
        for nxt in steps:
            nxt = nxt.select(F.col("src").alias("mid"), F.col("dst").alias("to")).distinct()
            most, lo, hi = nxt.groupBy("mid").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("lo"), F.max("to").alias("hi")).agg(F.max("n"), F.min("lo"), F.max("hi")).first()
            kind = nxt.schema["to"].dataType
            short = isinstance(lo, int) and -(2**31) <= lo and hi < 2**31
            nxt = nxt.withColumn("part", F.pmod(F.hash("to"), F.lit(1 + (most or 0) // LIST_ENDS))).withColumn("to", F.col("to").cast("int") if short else F.col("to"))
            lists = nxt.groupBy("mid", "part").agg(F.collect_list("to").alias("ends"), F.max(F.col("to").isNull()).alias("bare"))
            null = F.array(F.lit(None).cast(nxt.schema["to"].dataType))  # collect_list leaves it out
            lists = lists.select("mid", "part", F.when(F.col("bare"), F.concat("ends", null)).otherwise(F.col("ends")).alias("ends"))
            met = out.join(lists, F.col("dst").eqNullSafe(F.col("mid"))).select("src", "part", "ends").repartition("src", "part")
            out = met.select("src", "part", F.explode("ends").alias("dst")).distinct().select("src", F.col("dst").cast(kind).alias("dst"))
        if not named:
            of = lambda t, c: F.concat_ws("_", F.lit(t), F.col(c).cast("string")).alias(c)
            out = out.select(of(ends[0][0], "src"), of(ends[-1][1], "dst"))
        return out.where(F.col("src") != F.col("dst"))

    def _typed(self, edge_type: str) -> DataFrame:
        """An edge type's ends as given where they are whole numbers, else as text."""
        e = self.given[edge_type]
        whole = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint"}
        return e.select(*[F.col(c).cast(whole.get(e.schema[c].dataType.simpleString(), "string")).alias(c) for c in ("src", "dst")])

    def embed_metapath(self, metapath: list[str], feature_dim: int = 256, num_iterations: int = 40, **options) -> DataFrame:
        lines = self.metapath_pairs(metapath).select(F.concat_ws(" ", "src", "dst").alias("value"))
        return embed(graph_from_lines(lines, NODE), feature_dim, num_iterations, **options)
