"""Embedding drivers: initial vectors, propagation, normalisation, whitening."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.functions.hashing import init_local, init_vector
from hypergraph_spark.operators import linalg as la
from hypergraph_spark.plans.graph import HyperGraph, graph_from_lines
from hypergraph_spark.sources.lines import parse_line, update_lines

DIM, ITERATIONS = 256, 40


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local master may go without naming one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


def durable(df: DataFrame, tag: str = "emb") -> DataFrame:
    """df written to the shared checkpoint folder and read back, which cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def auto_iterations(feature_dim: int) -> int:
    """The number of rounds where none is given: the same for every dimension."""
    return ITERATIONS


def initialize(graph: HyperGraph, dim: int = DIM, seed: int = 0) -> DataFrame:
    return graph.entities.select("entity_id", init_vector(F.col("entity_id"), dim, seed).alias("v"))


def blend(new: DataFrame, old: DataFrame, residual: float) -> DataFrame:
    """(1 - residual) * new + residual * old."""
    j = new.join(old.select("entity_id", F.col("v").alias("o")), "entity_id")
    return j.select("entity_id", F.zip_with("v", "o", lambda x, y: x * (1 - residual) + y * residual).alias("v"))


def _post(x: np.ndarray, normalization: str, white: bool) -> np.ndarray:
    if normalization in ("l2", "spectral"):
        x = la.local_l2(x)
        if normalization == "spectral":
            values, vectors = np.linalg.eigh(x.T @ x)
            x = x @ la._signed(vectors[:, np.argsort(values)[::-1]])
    elif normalization == "l1":
        x = x / np.maximum(np.abs(x).sum(1, keepdims=True), la.EPS)
    elif normalization != "none":
        raise ValueError(f"unknown normalization {normalization!r}")
    if white and len(x) > 1:
        mean, m = la.whitening(len(x), x.sum(0), x.T @ x, None)
        x = (x - mean) @ m
    return x


def embed(
    graph: HyperGraph,
    feature_dim: int = DIM,
    num_iterations: int = ITERATIONS,
    propagation: str = "left",
    normalization: str = "l2",
    seed: int = 0,
    initial: DataFrame | None = None,
    residual_weight: float = 0.0,
    convergence_threshold: float = 0.0,
    whiten: bool = True,
    callback: Callable[[int, object], None] | None = None,
    edges: DataFrame | None = None,
    weight: str | None = None,
    distributed: bool | None = None,
) -> DataFrame:
    """(entity_id, v): `num_iterations` rounds of propagate, residual blend, normalise, whiten.

    Stops early from the second round on if the RMSE to the round before is under convergence_threshold. While the
    matrix fits LOCAL_BYTES it is broadcast to row-partitioned edges, one job a round without a shuffle; of the first
    vectors only the ids come to the driver, and of the last round nothing where no option asks for it there. Beyond, or
    if `distributed`, rows stay in Spark and each round is one join and one combined sum.
    """
    w = weight or graph.weight(propagation)
    cells = graph.edges if edges is None else edges
    x = initialize(graph, feature_dim, seed) if initial is None else graph.entities.select("entity_id").join(initial, "entity_id", "left")
    if initial is not None:
        x = x.select("entity_id", F.coalesce("v", F.array_repeat(F.lit(0.0), feature_dim)).alias("v"))
    if not distributed:
        x = x if initial is None else x.persist()  # counted, then collected
        distributed = (graph.entities if initial is None else x).count() * feature_dim * 8 > la.LOCAL_BYTES
    if not distributed:
        if initial is None:  # the ids are all that the driver needs
            ids = graph.entities.select("entity_id").orderBy("entity_id").toArrow().column(0).to_pylist()
            m = init_local(ids, feature_dim, seed)
        else:
            ids, m = la.to_local(x)
            x.unpersist()
        op = la.SparseOperator(cells, ids, w)
        plain = residual_weight <= 0 and convergence_threshold <= 0 and callback is None  # then no one asks for the last round here
        for it in range(num_iterations - plain):
            new = op.dot(m)
            if residual_weight > 0:
                new = (1 - residual_weight) * new + residual_weight * m
            new = _post(new, normalization, whiten)
            done = it > 0 and convergence_threshold > 0 and np.sqrt(np.mean((new - m) ** 2)) < convergence_threshold
            m = new
            if callback:
                callback(it, m)
            if done:
                break
        if plain and num_iterations > 0:
            rows, shared = op.dot_rows(m)
            rows = la.normalize(durable(rows), normalization)
            shared.destroy()
            op.close()
            return la.whiten(durable(rows)) if whiten else rows
        op.close()
        return la.to_emb(graph.entities.sparkSession, ids, m)
    x, cells = durable(x), durable(cells.select("src", "dst", w), "edges")
    for it in range(num_iterations):
        new = la.spmm(cells, x, w)
        if residual_weight > 0:
            new = blend(new, x, residual_weight)
        new = durable(la.normalize(new, normalization))
        if whiten:
            new = durable(la.whiten(new))
        done = it > 0 and convergence_threshold > 0 and la.rmse(new, x) < convergence_threshold
        x = new
        if callback:
            callback(it, x)
        if done:
            break
    return x


def embed_multiscale(graph: HyperGraph, feature_dim: int = DIM, scales: Iterable[int] = (1, 2, 4, 8), initial: DataFrame | None = None, **options) -> DataFrame:
    """The embeddings after each of the sorted scales, side by side; scales share their rounds."""
    out, x, done = None, initial, 0
    for s in sorted(set(scales)):
        x = embed(graph, feature_dim, s - done, initial=x, **options) if s > done else (x if x is not None else initialize(graph, feature_dim))
        done = max(done, s)
        out = x if out is None else out.join(x.select("entity_id", F.col("v").alias("u")), "entity_id").select("entity_id", F.concat("v", "u").alias("v"))
    return out


def embed_with_features(graph: HyperGraph, features: DataFrame, num_iterations: int = ITERATIONS, feature_weight: float = 0.5, **options) -> DataFrame:
    """Starts from (1 - w) * hash vectors + w * features (entity_id, v) where an entity has them."""
    sizes = [r[0] for r in features.select(F.size("v")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("features need one common length")
    base = initialize(graph, sizes[0])
    j = base.join(features.select("entity_id", F.col("v").alias("f")), "entity_id", "left")
    mixed = F.when(F.col("f").isNull(), F.col("v")).otherwise(F.zip_with("v", "f", lambda x, y: x * (1 - feature_weight) + y * feature_weight))
    return embed(graph, sizes[0], num_iterations, initial=j.select("entity_id", mixed.alias("v")), **options)


def attention_weights(cells: DataFrame, x: DataFrame, weight: str, temperature: float) -> DataFrame:
    """(src, dst, w): softmax over a row's edges of cosine / temperature, times the edge weight, rows renormalised."""
    a = x.select(F.col("entity_id").alias("src"), F.col("v").alias("a"))
    b = x.select(F.col("entity_id").alias("dst"), F.col("v").alias("b"))
    s = cells.select("src", "dst", F.col(weight).alias("w")).join(a, "src").join(b, "dst").select("src", "dst", "w", (la.cosine(F.col("a"), F.col("b")) / temperature).alias("s"))
    top = s.groupBy("src").agg(F.max("s").alias("top"))
    p = s.join(top, "src").withColumn("p", F.exp(F.col("s") - F.col("top")))
    z = p.groupBy("src").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("w")).alias("zw"))
    p = p.join(z, "src")
    pw = F.col("p") / F.col("z") * F.col("w")
    return p.select("src", "dst", (pw / F.greatest(F.col("zw") / F.col("z"), F.lit(la.EPS))).alias("w"))


def embed_with_attention(graph: HyperGraph, feature_dim: int = DIM, num_iterations: int = ITERATIONS, propagation: str = "left", normalization: str = "l2", attention_temperature: float = 1.0, seed: int = 0, whiten: bool = True) -> DataFrame:
    """One plain round, then rounds whose edge weights are re-weighted by similarity (attention_weights)."""
    w = graph.weight(propagation)
    cells = durable(graph.edges.select("src", "dst", w), "edges")
    x = durable(initialize(graph, feature_dim, seed))
    for it in range(num_iterations):
        current = cells.withColumnRenamed(w, "w") if it == 0 else attention_weights(cells, x, w, attention_temperature)
        x = la.normalize(la.spmm(current, x, "w"), normalization)
        x = durable(la.whiten(durable(x)) if whiten else x)
    return x


def row_normalized(edges: DataFrame, weight: str) -> DataFrame:
    s = edges.groupBy("src").agg(F.sum(weight).alias("s"))
    return edges.join(s, "src").select("src", "dst", F.when(F.col("s") > 0, F.col(weight) / F.col("s")).otherwise(F.lit(0.0)).alias("w"))


def embed_weighted(weighted: DataFrame, columns: str, trim_n: int = 16, weight_mode: str = "row", propagation: str = "left", **options) -> tuple[HyperGraph, DataFrame]:
    """(graph, embedding) of (value, weight) lines.

    weight_mode 'row' scales rows before they are normalised, which cancels the weights; 'edge' weighs the edges.
    """
    graph = graph_from_lines(weighted.select("value"), columns, trim_n)
    cells = graph.edges
    if weight_mode == "edge":
        t = weighted.select(F.flatten(parse_line(F.col("value"))).alias("t"), "weight")
        pair = t.select(F.explode("t").alias("src"), "t", "weight").select("src", F.explode("t").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("f"))
        cells = cells.join(pair, ["src", "dst"], "left").withColumn("left_w", F.col("left_w") * F.coalesce("f", F.lit(1.0)))
        cells = cells.withColumn("sym_w", F.col("sym_w") * F.coalesce("f", F.lit(1.0)))
    elif weight_mode != "row":
        raise ValueError(f"unknown weight_mode {weight_mode!r}")
    return graph, embed(graph, edges=row_normalized(cells, graph.weight(propagation)), weight="w", propagation=propagation, **options)


def directed_edges(graph: HyperGraph, lines: DataFrame) -> DataFrame:
    """(src, dst, w): left weights of the edges whose ends stand in that order in a line, rows renormalised."""
    t = lines.select(F.flatten(parse_line(F.col("value"))).alias("t"))
    first = t.select("t", F.posexplode("t").alias("i", "src"))
    order = first.select("src", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("dst")).distinct()
    return row_normalized(graph.edges.join(order, ["src", "dst"], "left_semi"), "left_w")


def embed_directed(lines: DataFrame, columns: str, trim_n: int = 16, **options) -> tuple[HyperGraph, DataFrame]:
    """(graph, embedding) along token order; entities without outgoing edges become zero."""
    graph = graph_from_lines(lines, columns, trim_n)
    return graph, embed(graph, edges=directed_edges(graph, lines), weight="w", **options)


def embed_edge_features(graph: HyperGraph, edge_features: DataFrame, feature_dim: int = DIM, num_iterations: int = ITERATIONS, combine: str = "concat", **options) -> DataFrame:
    """Structural embedding combined (concat, or mean of equal lengths) with propagated means of incident edge features (src, dst, v)."""
    base = embed(graph, feature_dim, num_iterations, **options)
    ends = edge_features.select(F.col("src").alias("entity_id"), "v").unionByName(edge_features.select(F.col("dst").alias("entity_id"), "v"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = ends.groupBy("entity_id").agg(Summarizer.mean(array_to_vector("v")).alias("m")).select("entity_id", vector_to_array("m").alias("v"))
    d = len(edge_features.select("v").first()[0])
    spread = embed(graph, d, num_iterations, initial=mean, **options)
    j = base.join(spread.select("entity_id", F.col("v").alias("u")), "entity_id")
    if combine == "concat":
        return j.select("entity_id", F.concat("v", "u").alias("v"))
    if combine == "mean" and d == feature_dim:
        return j.select("entity_id", F.zip_with("v", "u", lambda x, y: (x + y) / 2).alias("v"))
    raise ValueError("combine is 'concat', or 'mean' of equal lengths")


def embed_inductive(trained: DataFrame, existing: DataFrame, new: DataFrame, columns: str, num_iterations: int = ITERATIONS, trim_n: int = 16, seed: int = 0, **options) -> tuple[HyperGraph, DataFrame]:
    """(graph, embedding) of old and new lines: known entities start from their trained vectors, new ones from 0.01 of hash vectors."""
    graph = graph_from_lines(update_lines(existing, new), columns, trim_n)
    d = len(trained.select("v").first()[0])
    j = initialize(graph, d, seed).join(trained.select("entity_id", F.col("v").alias("t")), "entity_id", "left")
    start = j.select("entity_id", F.coalesce("t", F.transform("v", lambda x: x * 0.01)).alias("v"))
    return graph, embed(graph, d, num_iterations, initial=start, **options)


def propagate(graph: HyperGraph, emb: DataFrame, num_iterations: int = 1, **options) -> DataFrame:
    """Rounds from a given embedding."""
    return embed(graph, len(emb.select("v").first()[0]), num_iterations, initial=emb, **options)


def supervised_refine(emb: DataFrame, positive: DataFrame, negative: DataFrame | None = None, learning_rate: float = 0.01, num_epochs: int = 50, margin: float = 0.5, num_negatives: int = 5, seed: int = 42) -> DataFrame:
    """Sequential SGD on cosine over the entities of (src, dst) pairs: positives are drawn together, negatives pushed under margin.

    The embedding must fit the driver (size checked), as each step depends on the one before.
    """
    spark = emb.sparkSession
    ids, x = la.to_local(emb)
    at = {e: i for i, e in enumerate(ids)}
    known = lambda df: [(at[r[0]], at[r[1]]) for r in df.select("src", "dst").toLocalIterator() if r[0] in at and r[1] in at]
    pos = known(positive)
    rng = np.random.default_rng(seed)
    neg = known(negative) if negative is not None else [(a, int(b)) for a, _ in pos for b in rng.integers(0, len(ids), num_negatives) if a != b]

    def step(a: int, b: int, sign: float) -> None:
        na, nb = max(np.linalg.norm(x[a]), la.EPS), max(np.linalg.norm(x[b]), la.EPS)
        c = x[a] @ x[b] / (na * nb)
        ga, gb = x[b] / (na * nb) - c * x[a] / na**2, x[a] / (na * nb) - c * x[b] / nb**2
        x[a] += sign * learning_rate * ga
        x[b] += sign * learning_rate * gb

    cos = lambda a, b: x[a] @ x[b] / max(np.linalg.norm(x[a]) * np.linalg.norm(x[b]), la.EPS)
    for _ in range(num_epochs):
        loss = 0.0
        for a, b in pos:
            loss += 1 - cos(a, b)
            step(a, b, 1.0)
        for a, b in neg:
            if (over := cos(a, b) - margin) > 0:
                loss += over
                step(a, b, -1.0)
        if loss < 1e-6:
            break
    return la.to_emb(spark, ids, la.local_l2(x))


class Embedder:
    """fit / transform in the manner of an estimator."""

    _names = ("feature_dim", "num_iterations", "propagation", "normalization", "columns", "seed", "trim_n", "whiten")

    def __init__(self, feature_dim: int = DIM, num_iterations: int = ITERATIONS, propagation: str = "left", normalization: str = "l2", columns: str = "complex::reflexive::node", seed: int = 0, trim_n: int = 16, whiten: bool = True):
        self.feature_dim, self.num_iterations, self.propagation, self.normalization = feature_dim, num_iterations, propagation, normalization
        self.columns, self.seed, self.trim_n, self.whiten = columns, seed, trim_n, whiten
        self.graph_: HyperGraph | None = None
        self.embeddings_: DataFrame | None = None

    def get_params(self) -> dict:
        return {n: getattr(self, n) for n in self._names}

    def set_params(self, **params) -> Embedder:
        for n, v in params.items():
            if n not in self._names:
                raise ValueError(f"unknown parameter {n!r}")
            setattr(self, n, v)
        return self

    def fit(self, lines: DataFrame) -> Embedder:
        self.graph_ = graph_from_lines(lines, self.columns, self.trim_n)
        self.embeddings_ = embed(self.graph_, self.feature_dim, self.num_iterations, self.propagation, self.normalization, self.seed, whiten=self.whiten)
        return self

    def transform(self, lines: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the lines' known tokens."""
        if self.embeddings_ is None:
            raise RuntimeError("fit first")
        if lines is None:
            return self.embeddings_
        tokens = lines.select(F.explode(F.flatten(parse_line(F.col("value")))).alias("entity_id")).distinct()
        out = self.embeddings_.join(tokens, "entity_id", "left_semi")
        if out.isEmpty():
            raise ValueError("no token is known")
        return out

    def fit_transform(self, lines: DataFrame) -> DataFrame:
        return self.fit(lines).transform()


def lines_of(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")
