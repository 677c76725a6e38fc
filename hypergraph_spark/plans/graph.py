"""The hypergraph plan: hyperedges (a, b) to weighted entities and edges with Markov weights."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypergraph_spark.plans.spec import parse_spec, relations, single_relation
from hypergraph_spark.sources import lines as src


@dataclass
class HyperGraph:
    """entities (entity_id, column_id, row_sum) and directed edges (src, dst, value, left_w, sym_w).

    raw, if given, has the same edges as (src, dst, value), before the joins that give them their weights; half, if
    given, those with src <= dst of them.
    """

    entities: DataFrame
    edges: DataFrame
    columns: str
    raw: DataFrame | None = None
    half: DataFrame | None = None

    def __len__(self) -> int:
        return self.num_entities()

    def __repr__(self) -> str:
        return f"HyperGraph(columns={self.columns!r}, num_entities={self.num_entities()}, num_edges={self.num_edges()})"

    def __bool__(self) -> bool:
        return True

    def weight(self, propagation: str) -> str:
        if propagation not in ("left", "symmetric"):
            raise ValueError(f"propagation must be 'left' or 'symmetric', not {propagation!r}")
        return "left_w" if propagation == "left" else "sym_w"

    def cache(self) -> HyperGraph:
        self.entities, self.edges, self.raw, self.half = self.entities.cache(), self.edges.cache(), None, None
        return self

    def pairs(self) -> DataFrame:
        """(src, dst, value) of the directed edges, for what needs no weights."""
        return self.edges.select("src", "dst", "value") if self.raw is None else self.raw

    def half_pairs(self) -> DataFrame:
        """(src, dst, value) of the edges with src <= dst; every edge has its like in the other direction."""
        return self.pairs().where(F.col("src") <= F.col("dst")) if self.half is None else self.half

    def num_entities(self) -> int:
        return self.entities.count()

    def num_edges(self) -> int:
        """Directed edges, self-loops included."""
        return self.half_pairs().agg(directed()).first()[0]

    def degrees(self) -> DataFrame:
        return self.entities.select("entity_id", "row_sum")

    def column_mask(self, name: str) -> DataFrame:
        """(entity_id, mask): whether the entity was first seen in the column; all False for a reflexive spec."""
        spec = parse_spec(self.columns)
        names = [c.name for c in spec]
        if name not in names:
            raise ValueError(f"unknown column {name!r}")
        hit = F.lit(False) if any(c.reflexive for c in spec) else F.col("column_id") == names.index(name)
        return self.entities.select("entity_id", hit.alias("mask"))

    def neighbors(self, entity: str) -> DataFrame:
        return self.edges.where(F.col("src") == entity).select(F.col("dst").alias("entity_id"), F.col("left_w").alias("weight"))

    def index(self) -> DataFrame:
        """(idx, entity_id): entities numbered in order of their names, without one task sorting them all."""
        ordered = self.entities.select("entity_id").orderBy("entity_id")
        schema = "entity_id string, idx long"
        return ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF(schema).select("idx", "entity_id")

    def entity_indices(self, entities: Sequence[str]) -> list[int]:
        """The index numbers of some entities, in their order; ValueError names one that the graph lacks."""
        wanted = self.entities.sparkSession.createDataFrame([(e,) for e in dict.fromkeys(entities)], "entity_id string")
        found = {r["entity_id"]: r["idx"] for r in self.index().join(F.broadcast(wanted), "entity_id").collect()}
        for e in entities:
            if e not in found:
                raise ValueError(f"unknown entity {e!r}")
        return [found[e] for e in entities]

    def entity_index(self, entity: str) -> int:
        return self.entity_indices([entity])[0]

    def sparse(self, markov_type: str = "left") -> DataFrame:
        """(row, col, weight) triplets by index, row-sorted."""
        w, ix = self.weight(markov_type), self.index()
        out = self.edges.select("src", "dst", F.col(w).alias("weight"))
        out = out.join(ix.select(F.col("entity_id").alias("src"), F.col("idx").alias("row")), "src").join(ix.select(F.col("entity_id").alias("dst"), F.col("idx").alias("col")), "dst")
        return out.select("row", "col", "weight").orderBy("row", "col")

    def edge_list(self) -> DataFrame:
        """Undirected pairs once (src <= dst) with the weight of that direction."""
        return self.edges.where(F.col("src") <= F.col("dst")).select("src", "dst", F.col("left_w").alias("weight"))

    def save(self, path: str) -> None:
        self.entities.write.parquet(f"{path}/entities")
        self.edges.write.parquet(f"{path}/edges")
        spark = self.edges.sparkSession
        spark.createDataFrame([(json.dumps({"columns": self.columns}),)], "value string").coalesce(1).write.text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HyperGraph:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return HyperGraph(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges"), meta["columns"])


def _trimmed(h: DataFrame, reflexive: bool, trim_n: int) -> DataFrame:
    """h with high_a and high_b: each side's trim_n tokens of the largest global occurrence, ties by name.

    Only hyperedges over trim_n tokens are taken apart; the rest keep all their tokens without a shuffle.
    """
    long = (F.size("a") > trim_n) | (F.size("b") > trim_n)
    small = h.where(~long).withColumn("high_a", F.col("a")).withColumn("high_b", F.col("b"))
    sides = h.select(F.explode("a").alias("e"), F.size("b").alias("n"))
    if not reflexive:
        sides = sides.unionByName(h.select(F.explode("b").alias("e"), F.size("a").alias("n")))
    occ = sides.groupBy("e").agg((F.sum("n") * (2 if reflexive else 1)).alias("occ"))
    # Hyperedges are known by what they hold, not by a row number that another evaluation may deal out anew, nor by an
    # order of tokens that another evaluation may collect otherwise.
    held = [F.array_sort("a"), F.array_sort("b")]
    big = h.where(long).withColumn("hid", F.struct(F.xxhash64(*held).alias("x"), F.xxhash64(F.lit(1), *held).alias("y")))
    each = big.groupBy("hid").agg(F.first("a").alias("a"), F.first("b").alias("b"))

    def high(side: str) -> DataFrame:
        t = each.select("hid", F.posexplode(side).alias("pos", "e")).join(occ, "e")
        rank = F.row_number().over(Window.partitionBy("hid").orderBy(F.desc("occ"), "e", "pos"))
        return t.withColumn("rank", rank).where(F.col("rank") <= trim_n).groupBy("hid").agg(F.collect_list("e").alias(f"high_{side}"))

    a = high("a")
    b = a.withColumnRenamed("high_a", "high_b") if reflexive else high("b")
    got = big.join(a, "hid", "left").join(b, "hid", "left").drop("hid")
    return small.unionByName(got)


def build_graph(hyper: DataFrame, columns: str, trim_n: int = 16, normalizer: str = "reference") -> HyperGraph:
    """The graph of hyperedges (a, b).

    Pairs are generated inside each hyperedge's row, so expansion needs no join; the only shuffle before the weights
    are the sums per pair and per entity, both combined map-side. Every ordered pair of a and b gets 1 / (|a| |b|)
    in both directions, repeats counted; a token's row sum grows by one over the other side's size. trim_n keeps the
    pairs with a high token on either side. normalizer 'stochastic' divides by the rows' own sums instead, so that
    rows add up to 1 in bipartite graphs as well.
    """
    i, j = single_relation(parse_spec(columns))
    reflexive = i == j
    h = hyper.where((F.size("a") > 0) & (F.size("b") > 0))
    na, nb = F.size("a"), F.size("b")
    over_a = h.select(F.explode("a").alias("entity_id"), (1 / nb).alias("w"), F.lit(0).alias("column_id"))
    sums = over_a.withColumn("w", F.col("w") * 2) if reflexive else over_a.unionByName(h.select(F.explode("b").alias("entity_id"), (1 / na).alias("w"), F.lit(1).alias("column_id")))
    entities = sums.groupBy("entity_id").agg(F.min("column_id").alias("column_id"), F.sum("w").alias("row_sum"))
    value = (1 / (na * nb)).alias("value")
    if trim_n and trim_n > 0:
        t = _trimmed(h, reflexive, trim_n)
        pairs = t.select(F.explode("a").alias("x"), "b", "high_a", "high_b", value)
        pairs = pairs.select("x", F.explode("b").alias("y"), "high_a", "high_b", "value")
        pairs = pairs.where(F.array_contains("high_a", F.col("x")) | F.array_contains("high_b", F.col("y")))
    else:
        pairs = h.select(F.explode("a").alias("x"), "b", value).select("x", F.explode("b").alias("y"), "value")
    if reflexive:
        # Both directions of a pair are there, and alike: one is summed and then mirrored, which halves the shuffle.
        pairs = pairs.where(F.col("x") <= F.col("y"))
    summed = pairs.groupBy("x", "y").agg(F.sum("value").alias("value"))
    if reflexive:
        half = summed.select(F.col("x").alias("src"), F.col("y").alias("dst"), (F.col("value") * 2).alias("value"))
        edges = mirrored(half)
        weighted = mirrored(half_weights(half, entities), True) if normalizer == "reference" else with_weights(edges, entities, normalizer)
        return HyperGraph(entities, weighted, columns, edges, half)
    there = summed.select(F.col("x").alias("src"), F.col("y").alias("dst"), "value")
    edges = there.unionByName(summed.select(F.col("y").alias("src"), F.col("x").alias("dst"), "value")).groupBy("src", "dst").agg(F.sum("value").alias("value"))
    return HyperGraph(entities, with_weights(edges, entities, normalizer), columns, edges)


def mirrored(half: DataFrame, weights: bool = False) -> DataFrame:
    """Both directions of (src, dst, value) rows that hold each pair once, a self-loop once; made inside the row.

    With weights the rows have rs and rd, the row sums of src and dst, and get left_w and sym_w.
    """
    sym = F.col("value") / F.sqrt(F.col("rs") * F.col("rd"))

    def row(a: str, b: str, s: str) -> Column:
        more = [(F.col("value") / F.col(s)).alias("left_w"), sym.alias("sym_w")] if weights else []
        return F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("value"), *more)

    both = F.when(F.col("src") == F.col("dst"), F.array(row("src", "dst", "rs"))).otherwise(F.array(row("src", "dst", "rs"), row("dst", "src", "rd")))
    return half.select(F.explode(both).alias("e")).select("e.*")


def half_weights(half: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst, value, rs, rd): half with both ends' row sums, joined before the other direction is made: half the rows in both joins."""
    s = entities.select(F.col("entity_id").alias("src"), F.col("row_sum").alias("rs"))
    d = entities.select(F.col("entity_id").alias("dst"), F.col("row_sum").alias("rd"))
    return half.join(s, "src").join(d, "dst").select("src", "dst", "value", "rs", "rd")


def with_weights(edges: DataFrame, entities: DataFrame, normalizer: str = "reference") -> DataFrame:
    """edges with left_w = value / row_sum(src) and sym_w = value / sqrt(row_sum(src) row_sum(dst))."""
    if normalizer not in ("reference", "stochastic"):
        raise ValueError(f"unknown normalizer {normalizer!r}")
    s = entities.select(F.col("entity_id").alias("src"), F.col("row_sum").alias("rs"))
    if normalizer == "stochastic":
        s = edges.groupBy("src").agg(F.sum("value").alias("rs"))
    d = s.select(F.col("src").alias("dst"), F.col("rs").alias("rd"))
    out = edges.select("src", "dst", "value").join(s, "src").join(d, "dst")
    return out.select("src", "dst", "value", (F.col("value") / F.col("rs")).alias("left_w"), (F.col("value") / F.sqrt(F.col("rs") * F.col("rd"))).alias("sym_w"))


def left_weights(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with left_w alone, for what asks for no more: one join less."""
    out = edges.join(entities.select(F.col("entity_id").alias("src"), F.col("row_sum").alias("rs")), "src")
    return out.select("src", "dst", "value", (F.col("value") / F.col("rs")).alias("left_w"))


def graph_from_lines(lines: DataFrame, columns: str, trim_n: int = 16) -> HyperGraph:
    return build_graph(src.hyperedges(lines, columns), columns, trim_n)


def graph_from_files(spark: SparkSession, paths, columns: str, trim_n: int = 16) -> HyperGraph:
    return graph_from_lines(src.read_lines(spark, paths), columns, trim_n)


def directed(loops: bool = True) -> Column:
    """The number of directed edges in half_pairs."""
    return F.coalesce(F.sum(F.when(F.col("src") < F.col("dst"), 2).otherwise(1 if loops else 0)), F.lit(0)).cast("long")


def half_adjacency(graph: HyperGraph) -> DataFrame:
    """adjacency's rows with src < dst."""
    return graph.half_pairs().where(F.col("src") < F.col("dst")).select("src", "dst")


def half_degrees(half: DataFrame) -> DataFrame:
    """(src, d): the degrees of entities with a neighbour, from half_adjacency."""
    return half.select(F.explode(F.array("src", "dst")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("d"))


def adjacency(graph: HyperGraph) -> DataFrame:
    """The undirected 0/1 adjacency without self-loops, both directions; a graph's edges are distinct."""
    return graph.pairs().where(F.col("src") != F.col("dst")).select("src", "dst")


def legacy_relations(cells: DataFrame, columns: str, prepend_field: bool = True) -> DataFrame:
    """(relation, src, dst, value, weight, occurrence) of all relations of a legacy spec.

    cells: rows of ARRAY<ARRAY<STRING>>. A row's cartesian product of all columns (a reflexive one twice) weighs 1;
    entities are salted with their column's name; rows are normalised by their own sums; occurrence counts the
    products an entity stands in.
    """
    spec = parse_spec(columns, legacy=True)
    kept = cells.where(F.size("cells") == len(spec))
    total = reduce(lambda x, y: x * y, [F.size(F.col("cells")[k]) ** (2 if c.reflexive else 1) for k, c in enumerate(spec) if not c.ignore])
    out = None
    for i, j in relations(spec):
        name = lambda k, e: F.concat(F.lit(spec[k].name + "__"), F.col(e)) if prepend_field else F.col(e)  # noqa: B023, E731
        x = kept.select(F.explode(F.col("cells")[i]).alias("x"), F.col("cells")[j].alias("other"), total.alias("total"), F.size(F.col("cells")[i]).alias("ni"), F.size(F.col("cells")[j]).alias("nj"))
        pair = x.select("x", F.explode("other").alias("y"), (1 / (F.col("ni") * F.col("nj"))).alias("v"), (F.col("total") / (F.col("ni") * F.col("nj"))).alias("occ"))
        pair = pair.select(name(i, "x").alias("x"), name(j, "y").alias("y"), "v", "occ")
        salts = [spec[k].name + "__" if prepend_field else "" for k in (i, j)]
        if not (salts[0].startswith(salts[1]) or salts[1].startswith(salts[0])):  # no name is on both sides
            once = pair.groupBy("x", "y").agg(F.sum("v").alias("value"), F.sum("occ").alias("occ"))
        else:  # the lesser end first, none before any; a loop counts for both directions
            swap = F.coalesce(F.col("y") < F.col("x"), F.col("y").isNull() & F.col("x").isNotNull())
            k = F.when(F.col("x").eqNullSafe(F.col("y")), 2.0).otherwise(1.0)
            once = pair.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), (k * F.col("v")).alias("v"), (k * F.col("occ")).alias("occ"))
            once = once.groupBy("x", "y").agg(F.sum("v").alias("value"), F.sum("occ").alias("occ"))
        way = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.col("value"), F.col("occ"))
        both = F.when(F.col("x").eqNullSafe(F.col("y")), F.array(way("x", "y"))).otherwise(F.array(way("x", "y"), way("y", "x")))
        one = once.select(F.explode(both).alias("e")).select("e.*")
        sums = one.groupBy("x").agg(F.sum("value").alias("s"), F.sum("occ").alias("occurrence"))
        one = one.drop("occ").join(sums, "x").select(F.lit(f"{spec[i].name}__{spec[j].name}").alias("relation"), F.col("x").alias("src"), F.col("y").alias("dst"), "value", (F.col("value") / F.col("s")).alias("weight"), F.col("occurrence").cast("long").alias("occurrence"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the spec has no relation")
    return out
