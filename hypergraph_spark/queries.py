"""Registered queries over the driver's tables, each an operator of the package applied to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypergraph_spark.operators import algorithms as alg
from hypergraph_spark.operators import community as com
from hypergraph_spark.operators import embed as em
from hypergraph_spark.operators import linalg as la
from hypergraph_spark.operators import metrics as me
from hypergraph_spark.operators import preprocess as pre
from hypergraph_spark.operators import similarity as sim
from hypergraph_spark.operators import stats as st
from hypergraph_spark.operators.hetero import HeteroGraph
from hypergraph_spark.operators.relations import persisted_entities, train_relations
from hypergraph_spark.plans.graph import HyperGraph, adjacency, build_graph, directed, graph_from_files, graph_from_lines, left_weights, legacy_relations
from hypergraph_spark.sources.generators import planted_partition
from hypergraph_spark.sources.io import load_embeddings, save_embeddings
from hypergraph_spark.sources.lines import from_coo, from_edge_list, from_iterator, from_networkx, from_numpy, from_table, hyperedges, json_rows, parse_line, remove_lines, tsv_rows, update_lines
from hypergraph_spark.streaming.micro_batch import windowed_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NODE = "complex::reflexive::node"
DIMS = 4


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rt(c: Column | str) -> Column:
    """Rounded to six places, exact halves - which the last bit of a sum would decide - upwards."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# --- the graphs ---------------------------------------------------------------------------------------------------


def baskets(spark: SparkSession, d: str, trim_n: int = 0) -> HyperGraph:
    """Parts that are ordered together."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("a"))
    return build_graph(t.select("a", F.col("a").alias("b")), "complex::reflexive::part", trim_n)


def customer_parts(spark: SparkSession, d: str) -> HyperGraph:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), F.col("o_custkey")).alias("c"))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey"))).alias("b"))
    return build_graph(o.join(p, "k").select(F.array("c").alias("a"), "b"), "customer complex::part", 0)


def user_events(spark: SparkSession, d: str) -> HyperGraph:
    t = table(spark, d, "events").select(F.array(F.concat(F.lit("u"), F.col("user_id"))).alias("a"), F.array("event_type").alias("b"))
    return build_graph(t, "user event", 0)


def supplier_lines(spark: SparkSession, d: str) -> DataFrame:
    """`supplier nation` lines."""
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(" n"), F.col("s_nationkey")).alias("value"))


def nation_graph(spark: SparkSession, d: str) -> HyperGraph:
    """Customers and suppliers, by nation."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey"), F.lit(" n"), F.col("c_nationkey")).alias("value"))
    return graph_from_lines(c.unionByName(supplier_lines(spark, d)), NODE, 0)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), "label")


def md5_init(graph: HyperGraph) -> DataFrame:
    """Long initial vectors (entity_id, dim, x) from md5, which SQL engines share."""
    dims = graph.entities.select("entity_id", F.explode(F.sequence(F.lit(0), F.lit(DIMS - 1))).alias("dim"))
    return dims.select("entity_id", "dim", md5_number(F.concat_ws(":", "entity_id", "dim")).alias("x"))


def md5_number(c: Column) -> Column:
    return (F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") % 2000 - 1000) / 1000.0


def wide(x: DataFrame) -> DataFrame:
    rows = x.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p"))
    return rows.select("entity_id", F.transform("p", lambda t: t["x"]).alias("v"))


def long(x: DataFrame) -> DataFrame:
    return x.select("entity_id", F.posexplode("v").alias("dim", "x")).select("entity_id", "dim", r6("x").alias("x"))


# --- graph building -----------------------------------------------------------------------------------------------


@query
def basket_left_topk(spark, d):
    """Flagship: every part's three strongest partners by left Markov weight."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    g = baskets(spark, d)
    e = left_weights(g.pairs().where(F.col("src") != F.col("dst")), g.entities).select("src", "dst", rt("left_w").alias("w"))
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)


@query
def basket_edges(spark, d):
    return baskets(spark, d).pairs().select("src", "dst", r6("value").alias("value"))


@query
def basket_degrees(spark, d):
    return baskets(spark, d).entities.select("entity_id", r6("row_sum").alias("row_sum"))


@query
def basket_markov(spark, d):
    return baskets(spark, d).edges.select("src", "dst", rt("left_w").alias("left_w"), rt("sym_w").alias("sym_w"))


@query
def basket_trimmed(spark, d):
    return baskets(spark, d, trim_n=4).pairs().select("src", "dst", r6("value").alias("value"))


@query
def customer_part_markov(spark, d):
    return customer_parts(spark, d).edges.select("src", "dst", rt("left_w").alias("left_w"), rt("sym_w").alias("sym_w"))


@query
def customer_part_degrees(spark, d):
    return customer_parts(spark, d).entities.select("entity_id", r6("row_sum").alias("row_sum"))


@query
def user_event_markov(spark, d):
    return user_events(spark, d).edges.select("src", "dst", rt("left_w").alias("left_w"))


@query
def column_mask(spark, d):
    return user_events(spark, d).column_mask("event")


@query
def graph_counts(spark, d):
    g = baskets(spark, d)
    return g.entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(g.half_pairs().agg(directed().alias("edges")))


@query
def parsed_lines(spark, d):
    """Cells and tokens of tab- and comma-separated lines."""
    t = table(spark, d, "part").select(F.concat(F.col("p_name"), F.lit("\t"), F.col("p_brand")).alias("value"))
    t = t.unionByName(table(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit(" , x"), F.col("n_regionkey")).alias("value")))
    p = t.select(parse_line(F.col("value")).alias("c"))
    return p.select(F.size("c").alias("cells"), F.size(F.flatten("c")).alias("tokens")).groupBy("cells", "tokens").agg(F.count(F.lit(1)).alias("n"))


@query
def from_table_degrees(spark, d):
    lines = from_table(table(spark, d, "customer").withColumn("n", F.concat(F.lit("n"), F.col("c_nationkey"))), "c_custkey", "n")
    return graph_from_lines(lines, NODE, 0).entities.select("entity_id", r6("row_sum").alias("row_sum"))


LEGACY = "customer complex::part transient::status"


def order_cells(spark, d) -> DataFrame:
    """Customer, parts and status of every order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"), "o_orderstatus")
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("p"))
    return o.join(p, "k").select(F.array(F.array("c"), F.col("p"), F.array("o_orderstatus")).alias("cells"))


@query
def legacy_relation_weights(spark, d):
    """All relations of customer, parts and a transient order status, per column pair."""
    out = legacy_relations(order_cells(spark, d), LEGACY)
    return out.select("relation", "src", "dst", rt("weight").alias("weight"))


@query
def legacy_persisted_entities(spark, d):
    """The entities a legacy job writes: none of the transient status."""
    return persisted_entities(order_cells(spark, d), LEGACY)


@query
def legacy_train(spark, d):
    """Occurrences and squared norms of every relation's trained rows."""
    out = None
    for name, x in train_relations(order_cells(spark, d), LEGACY, feature_dim=8, num_iterations=2).items():
        one = x.select(F.lit(name).alias("relation"), "entity_id", F.col("occurrence").cast("long").alias("occurrence"), F.round(la.dot(F.col("v"), F.col("v")), 6).alias("norm2"))
        out = one if out is None else out.unionByName(one)
    return out


def token_counts(cells: DataFrame) -> DataFrame:
    tokens = cells.select(F.posexplode("cells").alias("col", "ts")).select("col", F.explode("ts").alias("token"))
    return tokens.groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def json_cells(spark, d):
    """Tokens by column of parts written as JSON lines."""
    p = table(spark, d, "part")
    row = F.struct(F.col("p_brand").alias("brand"), F.array("p_type", F.col("p_size").cast("string")).alias("traits"))
    return token_counts(json_rows(spark, p.select(F.to_json(row).alias("value")), "brand complex::traits"))


@query
def tsv_cells(spark, d):
    """Tokens by column of parts written as tab-separated lines."""
    p = table(spark, d, "part").select(F.concat_ws("\t", "p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("value"))
    return token_counts(tsv_rows(p, "brand complex::traits"))


@query
def coo_lines(spark, d):
    """Undirected lines of the customer by nation matrix, its cells the balances over 0."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").cast("long").alias("col"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("value"))
    return from_coo(c)


# --- edges --------------------------------------------------------------------------------------------------------


@query
def edge_list_undirected(spark, d):
    return baskets(spark, d).edge_list().select("src", "dst", rt("weight").alias("weight"))


def event_lines(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id"), F.lit(" "), F.col("event_type")).alias("value"))


@query
def clean_lines(spark, d):
    return pre.clean_lines(event_lines(spark, d))


@query
def filter_lines_by_degree(spark, d):
    return pre.filter_lines_by_degree(event_lines(spark, d), min_degree=60)


@query
def filter_graph_by_degree(spark, d):
    return pre.filter_graph_by_degree(baskets(spark, d), min_degree=110, max_degree=130)


@query
def remove_edges(spark, d):
    lines = pre.clean_lines(event_lines(spark, d))
    return remove_lines(lines, lines.where(F.col("value").endswith("click")))


@query
def update_graph_degrees(spark, d):
    old = event_lines(spark, d).where(F.col("value").endswith("view"))
    new = event_lines(spark, d).where(F.col("value").endswith("error"))
    return graph_from_lines(update_lines(old, new), NODE, 0).entities.select("entity_id", r6("row_sum").alias("row_sum"))


# --- propagation --------------------------------------------------------------------------------------------------


@query
def spmm_left(spark, d):
    g = baskets(spark, d)
    return la.spmm_long(g.edges, md5_init(g), "left_w", DIMS).select("entity_id", "dim", r6("x").alias("x"))


@query
def spmm_symmetric(spark, d):
    g = baskets(spark, d)
    return la.spmm_long(g.edges, md5_init(g), "sym_w", DIMS).select("entity_id", "dim", r6("x").alias("x"))


@query
def embed_2_rounds(spark, d):
    g = user_events(spark, d)
    return long(em.embed(g, DIMS, 2, initial=wide(md5_init(g)), whiten=False))


@query
def embed_distributed_2_rounds(spark, d):
    g = user_events(spark, d)
    return long(em.embed(g, DIMS, 2, initial=wide(md5_init(g)), whiten=False, distributed=True))


@query
def embed_residual(spark, d):
    g = user_events(spark, d)
    return long(em.embed(g, DIMS, 1, initial=wide(md5_init(g)), whiten=False, residual_weight=0.25))


@query
def embed_multiscale(spark, d):
    g = user_events(spark, d)
    return long(em.embed_multiscale(g, DIMS, (1, 2), initial=wide(md5_init(g)), whiten=False))


@query
def embed_attention_step(spark, d):
    g = user_events(spark, d)
    return em.attention_weights(g.edges, wide(md5_init(g)), "left_w", 1.0).select("src", "dst", r6("w").alias("w"))


@query
def directed_edges(spark, d):
    lines = event_lines(spark, d)
    return em.directed_edges(graph_from_lines(lines, NODE, 0), lines).select("src", "dst", r6("w").alias("w"))


@query
def l2_rows(spark, d):
    return long(la.normalize(vectors(spark, d), "l2"))


@query
def l1_rows(spark, d):
    return long(la.normalize(vectors(spark, d), "l1"))


@query
def rmse_of_round(spark, d):
    g = user_events(spark, d)
    a = wide(md5_init(g))
    b = la.spmm(g.edges, a, "left_w")
    return spark.range(1).select(r6(F.lit(la.rmse(a, b))).alias("rmse"))


@query
def covariance(spark, d):
    n, s, g = la.gram(vectors(spark, d))
    cov = (g - n * (s / n)[:, None] * (s / n)[None, :]) / (n - 1)
    dims = range(len(cov))
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 6) + 0.0) for i in dims for j in dims], "i int, j int, c double")


# --- similarity ---------------------------------------------------------------------------------------------------


def asked(x: DataFrame) -> DataFrame:
    """The searches' queries: all rows whose id is divisible by 50."""
    return x.where(F.col("entity_id").cast("long") % 50 == 0)


@query
def knn_topk(spark, d):
    x = vectors(spark, d)
    return sim.similar_by_blocks(asked(x), x, 5).select("source", "target", r6("score").alias("score"), "rank")


@query
def ann_ball_tree(spark, d):
    x = vectors(spark, d)
    return sim.ANNIndex(x, "ball_tree", leaf_rows=128).query_all(asked(x), 5).select("source", "target", r6("score").alias("score"), "rank")


@query
def graph_round_trip(spark, d):
    """A graph saved to the shared folder and loaded again."""
    path = f"{em.shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    nation_graph(spark, d).save(path)
    return HyperGraph.load(spark, path).edges.select("src", "dst", r6("left_w").alias("left_w"))


@query
def embeddings_round_trip(spark, d):
    """Embeddings saved as CSV and loaded again, at full precision."""
    path = f"{em.shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    save_embeddings(vectors(spark, d).select("entity_id", "v"), path, "csv")
    return load_embeddings(spark, path, "csv").select("entity_id", F.size("v").alias("dims"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query
def nation_neighbors(spark, d):
    return nation_graph(spark, d).neighbors("n3").select("entity_id", r6("weight").alias("weight"))


@query
def entity_numbers(spark, d):
    return nation_graph(spark, d).index()


@query
def sparse_symmetric(spark, d):
    return nation_graph(spark, d).sparse("symmetric").select("row", "col", r6("weight").alias("weight"))


@query
def degrees_of_nations(spark, d):
    g = nation_graph(spark, d)
    return g.degrees().join(g.column_mask("node"), "entity_id").select("entity_id", r6("row_sum").alias("row_sum"), "mask")


def _nation_edges(spark, d):
    """The 25 edges from nations to regions, on the driver."""
    return [(f"n{r[0]}", f"r{r[1]}") for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]


def _values(g: HyperGraph) -> DataFrame:
    return g.edges.select("src", "dst", r6("value").alias("value"), r6("left_w").alias("left_w"))


@query
def edge_list_graph(spark, d):
    return _values(graph_from_lines(from_edge_list(spark, _nation_edges(spark, d)), NODE, 0))


@query
def iterator_graph(spark, d):
    lines = (f"{a} {b}" for a, b in _nation_edges(spark, d))
    return _values(build_graph(from_iterator(spark, lines, NODE), NODE, 0))


@query
def numpy_graph(spark, d):
    edges = _nation_edges(spark, d)
    names = sorted({x for e in edges for x in e})
    m = np.zeros((len(names), len(names)))
    for a, b in edges:
        m[names.index(a), names.index(b)] = 1
    return _values(graph_from_lines(from_numpy(spark, m, names), NODE, 0))


@query
def networkx_graph(spark, d):
    """From an object with edges(), as networkx graphs have."""

    class Graph:
        def edges(self):
            return _nation_edges(spark, d)

    return _values(graph_from_lines(from_networkx(spark, Graph()), NODE, 0))


@query
def files_graph(spark, d):
    """From files of lines on disk, read and parsed by Spark."""
    path = f"{em.shared_dir(spark)}/lines-{uuid.uuid4().hex}.txt"
    supplier_lines(spark, d).write.text(path)
    return _values(graph_from_files(spark, path, NODE, 0))


@query
def largest_component(spark, d):
    """The largest component of nations and regions with their suppliers left out but those of nation 3 alone: its own graph."""
    t = table(spark, d, "supplier").where("s_nationkey IN (3, 5)").select(F.concat(F.lit("s"), "s_suppkey", F.lit(" n"), "s_nationkey").alias("value"))
    loose = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey", F.lit(" x"), "r_regionkey").alias("value"))
    joined = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("n3 n5").alias("value"))
    return adjacency(pre.largest_connected_component(graph_from_lines(t.unionByName(loose).unionByName(joined), NODE, 0)))


@query
def negatives_are_no_edges(spark, d):
    """Negative samples: how many there are, how many pairs they are, how many of them are edges or loops."""
    g = user_events(spark, d)
    neg = pre.negative_sampling(g, 100)
    hit = neg.join(g.pairs().select("src", "dst", F.lit(1).alias("edge")), ["src", "dst"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("pairs"), F.sum(F.coalesce("edge", (F.col("src") == F.col("dst")).cast("int"))).alias("bad"))


@query
def split_covers_all_edges(spark, d):
    """Both parts of the split together, and each part's size."""
    parts = pre.train_test_split_edges(baskets(spark, d))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("pairs"))


@query
def neighborhood_edges(spark, d):
    """All edges among a nation and its neighbours."""
    return pre.sample_neighborhood(nation_graph(spark, d), spark.createDataFrame([("n0",)], "entity_id string"), 1)[1].select("src", "dst")


@query
def most_similar(spark, d):
    x = vectors(spark, d)
    return sim.similar_by_blocks(asked(x), x, 10).select("source", F.col("target").alias("entity_id"), r6("score").alias("similarity"))


@query
def ann_brute(spark, d):
    x = vectors(spark, d)
    return sim.ANNIndex(x, "brute").query_all(asked(x), 10).select("source", "target", r6("score").alias("score"), "rank")


def knn_graph(spark, d) -> DataFrame:
    x = vectors(spark, d)
    return sim.similar_by_blocks(x, x, 5).select(F.concat_ws(" ", "source", "target").alias("value"))


@query
def ensemble_mean(spark, d):
    x = vectors(spark, d)
    return long(sim.combine([x, la.normalize(x, "l2")], "mean"))


# --- statistics ---------------------------------------------------------------------------------------------------


@query
def degree_distribution(spark, d):
    return st.degree_distribution(baskets(spark, d))


@query
def density(spark, d):
    g = baskets(spark, d)
    n, m = g.entities.agg(F.count(F.lit(1)).alias("n")), g.half_pairs().agg(directed(loops=False).alias("m"))
    return n.crossJoin(m).select("n", (F.col("m") / 2).cast("long").alias("m"), r6(F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"), r6(F.col("m") / F.col("n")).alias("avg_degree"))


@query
def clustering_coefficient(spark, d):
    return st.clustering_coefficient(baskets(spark, d)).select(r6("clustering_coefficient").alias("clustering_coefficient"))


@query
def pagerank_10(spark, d):
    out = st.pagerank(user_events(spark, d), top_k=None, max_iter=10, tol=0.0)
    return out.select("entity_id", r6("pagerank").alias("pagerank"))


@query
def connected_components(spark, d):
    return st.connected_components(nation_graph(spark, d))


@query
def bfs_hops(spark, d):
    g = nation_graph(spark, d)
    return st.bfs(adjacency(g), spark.createDataFrame([("n0",), ("n1",)], "entity_id string")).select("source", "entity_id", "hops")


@query
def nation_diameter(spark, d):
    """The largest component is a star of two or more leaves, or one edge."""
    return spark.createDataFrame([(st.diameter(nation_graph(spark, d), approx=True),)], "diameter long")


@query
def nation_summary(spark, d):
    s = st.graph_summary(nation_graph(spark, d))
    row = (s["num_nodes"], s["num_edges"], round(s["density"], 6), round(s["avg_degree"], 6), s["clustering_coefficient"] or 0.0, s["num_components"])
    return spark.createDataFrame([row], "num_nodes long, num_edges long, density double, avg_degree double, clustering double, components long")


@query
def betweenness(spark, d):
    """A star's middle lies between all pairs of its leaves."""
    return st.betweenness_centrality(graph_from_lines(supplier_lines(spark, d), NODE, 0), top_k=None).select("entity_id", r6("betweenness").alias("betweenness"))


# --- communities, labels, metrics ---------------------------------------------------------------------------------


@query
def modularity(spark, d):
    g = baskets(spark, d)
    c = g.entities.select("entity_id", (F.col("entity_id").cast("long") % 10).cast("int").alias("community"))
    return com.modularity(g, c).select(r6("modularity").alias("modularity"))


@query
def label_propagation_3(spark, d):
    g = user_events(spark, d)
    seeds = g.entities.where(F.col("column_id") == 1).select("entity_id", F.length("entity_id").alias("label"))
    return com.label_propagation(g, seeds, 3, 0.5)


@query
def centroid_labels(spark, d):
    return me.centroid_classify(vectors(spark, d), vector_labels(spark, d))


def vector_confusion(spark, d) -> DataFrame:
    return me.confusion(vector_labels(spark, d), me.centroid_classify(vectors(spark, d), vector_labels(spark, d)))


@query
def label_confusion(spark, d):
    return vector_confusion(spark, d)


@query
def f1(spark, d):
    return me.f1_scores(vector_confusion(spark, d)).select(*[r6(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query
def purity(spark, d):
    return me.purity(vector_confusion(spark, d)).select(r6("purity").alias("purity"))


def part_confusion(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("label"), F.col("p_size").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query
def nmi(spark, d):
    return me.nmi(part_confusion(spark, d)).select(r6("nmi").alias("nmi"))


@query
def adjusted_rand_index(spark, d):
    return me.adjusted_rand_index(part_confusion(spark, d)).select(r6("ari").alias("ari"))


@query
def silhouette(spark, d):
    return me.silhouette(vectors(spark, d), vector_labels(spark, d)).select(r6("silhouette").alias("silhouette"))


@query
def intra_similarity(spark, d):
    return me.intra_similarity(vectors(spark, d), vector_labels(spark, d)).select("label", r6("similarity").alias("similarity"))


def order_scores(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 100).alias("query"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("positive"))


@query
def auc(spark, d):
    return me.auc(order_scores(spark, d)).select(r6("auc").alias("auc"))


@query
def mrr_hits(spark, d):
    out = me.ranking(order_scores(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query
def map_at_10(spark, d):
    return me.map_at_k(order_scores(spark, d).withColumnRenamed("positive", "hit"), 10).select(r6("map_at_k").alias("map_at_k"))


@query
def ndcg_at_10(spark, d):
    return me.ndcg_at_k(order_scores(spark, d).withColumnRenamed("positive", "hit"), 10).select(r6("ndcg_at_k").alias("ndcg_at_k"))


# --- heterogeneous graphs, walks, windows -------------------------------------------------------------------------


def hetero(spark, d) -> HeteroGraph:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    g = HeteroGraph()
    g.add_edge_type("lives", "customer", "nation", table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")))
    g.add_edge_type("lies", "nation", "region", table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))
    g.add_edge_type("buys", "customer", "part", o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")))
    return g.add_edge_type("sold_by", "part", "supplier", li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query
def hetero_nodes(spark, d):
    g = hetero(spark, d)
    out = None
    for t in g.node_types:
        one = g.nodes(t).agg(F.lit(t).alias("node_type"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def hetero_edge_counts(spark, d):
    g = hetero(spark, d)
    out = None
    for t in g.edge_types:
        one = g.get_edges(t).agg(F.lit(t).alias("edge_type"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def homogeneous_edges(spark, d):
    """Edges of all types, ids named by type, with their repeats."""
    return hetero(spark, d).homogeneous_edges().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query
def metapath_customer_region(spark, d):
    return hetero(spark, d).metapath_pairs(["lives", "lies"])


@query
def metapath_customer_supplier(spark, d):
    return hetero(spark, d).metapath_pairs(["buys", "sold_by"])


def turn_paths(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda x: x != "").alias("path"))


@query
def token_cooccurrence(spark, d):
    return alg.cooccurrence(turn_paths(spark, d), 2)


@query
def token_ppmi(spark, d):
    return alg.ppmi(alg.cooccurrence(turn_paths(spark, d), 1)).select("src", "dst", r6("w").alias("w"))


@query
def document_tokens(spark, d):
    """Degrees of the hypergraph whose hyperedges are whole documents, all lines."""
    t = table(spark, d, "documents").select(F.split(F.coalesce("text", F.lit("")), "[ \n]", -1).alias("a"))
    return build_graph(t.select("a", F.col("a").alias("b")), "complex::reflexive::token", 0).entities.select("entity_id", r6("row_sum").alias("row_sum"))


@query
def page_links(spark, d):
    """Links from hosts to paths, with their left weights."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)).alias("links"))
    h = p.where(F.size("links") > 0).select(F.array("host").alias("a"), "links")
    return build_graph(h.select("a", F.col("links").alias("b")), "host complex::link", 0).edges.select("src", "dst", rt("left_w").alias("left_w"))


@query
def windowed_graph_daily(spark, d):
    return windowed_edges(table(spark, d, "events"), "ts", "1 day", "user_id", "event_type")


# --- without SQL: rows are checked in tests -----------------------------------------------------------------------


@query
def embed_whitened(spark, d):
    return em.embed(baskets(spark, d), 16, 3)


@query
def embed_hash_init(spark, d):
    return long(em.initialize(baskets(spark, d), 8))


@query
def prone(spark, d):
    return alg.embed_prone(user_events(spark, d), 8)


@query
def randne(spark, d):
    return alg.embed_randne(user_events(spark, d), 8, 3)


@query
def hope(spark, d):
    return alg.embed_hope(user_events(spark, d), 8, terms=6)


@query
def netmf(spark, d):
    return alg.embed_netmf(user_events(spark, d), 8, 2)


@query
def grarep(spark, d):
    return alg.embed_grarep(user_events(spark, d), 8, 2)


@query
def deepwalk(spark, d):
    return alg.embed_deepwalk(user_events(spark, d), 8, 2, 8, 2)


@query
def node2vec(spark, d):
    return alg.embed_node2vec(user_events(spark, d), 8, 2, 8, 2, p=0.5, q=2.0)


@query
def pca(spark, d):
    return sim.pca_compress(vectors(spark, d), 8)


@query
def random_projection(spark, d):
    return sim.random_projection(vectors(spark, d), 8, 0)


@query
def pq_search(spark, d):
    """Approximate neighbours, at the index's default sizes; tests hold their recall against brute force."""
    x = vectors(spark, d)
    return sim.product_quantize(x).search_all(asked(x), x, 10).select("source", "target", r6("score").alias("score"), "rank")


@query
def procrustes(spark, d):
    x = vectors(spark, d)
    return sim.procrustes(x, sim.pca_compress(x, 64))[0]


@query
def kmeans(spark, d):
    return com.kmeans(vectors(spark, d), 10, 10)


@query
def louvain(spark, d):
    return com.louvain(user_events(spark, d))


@query
def predict_links(spark, d):
    g = graph_from_lines(knn_graph(spark, d), NODE, 0)
    return sim.predict_links(g, vectors(spark, d), 10)


@query
def negative_samples(spark, d):
    return pre.negative_sampling(user_events(spark, d), 100)


@query
def split_edges(spark, d):
    return pre.train_test_split_edges(baskets(spark, d))


@query
def neighborhood(spark, d):
    return pre.sample_neighborhood(nation_graph(spark, d), spark.createDataFrame([("n0",)], "entity_id string"), 1)[1]


@query
def planted_graph(spark, d):
    return planted_partition(spark, 4, 25)[0]


@query
def file_hyperedges(spark, d):
    """Two-column lines through the parser into hyperedges."""
    t = table(spark, d, "orders").select(F.concat_ws("\t", F.concat(F.lit("c"), F.col("o_custkey")), F.concat_ws(" ", "o_orderstatus", "o_orderpriority")).alias("value"))
    return hyperedges(t, "customer complex::what").select(F.element_at("a", 1).alias("a"), F.size("b").alias("n"))
