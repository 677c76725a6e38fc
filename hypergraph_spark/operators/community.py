"""Community detection and classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.operators import linalg as la
from hypergraph_spark.operators.embed import durable
from hypergraph_spark.plans.graph import HyperGraph, adjacency, half_adjacency, half_degrees


def kmeans(emb: DataFrame, k: int, max_iterations: int = 100, seed: int = 42) -> DataFrame:
    """(entity_id, community): spherical k-means from k drawn rows; an empty cluster keeps its centroid."""
    n = emb.count()
    if not 2 <= k <= n:
        raise ValueError("k must lie between 2 and the number of rows")
    unit = durable(la.normalize(emb, "l2"), "unit")
    c = np.array([r[0] for r in unit.orderBy(F.xxhash64(F.lit(seed), "entity_id"), "entity_id").limit(k).select("v").collect()], float)
    before = None
    for _ in range(max_iterations):
        label = _nearest(unit, c)
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        sums = label.groupBy("community").agg(Summarizer.sum(array_to_vector("v")).alias("s"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("entity_id", "community")).alias("x")).collect()
        state = sorted((r["community"], r["n"], r["x"]) for r in sums)
        if state == before:
            break
        before = state
        for r in sums:
            c[r["community"]] = np.array(r["s"]) / max(np.linalg.norm(r["s"]), la.EPS)
    return _nearest(unit, c).select("entity_id", "community")


def _nearest(emb: DataFrame, c: np.ndarray) -> DataFrame:
    import pandas as pd  # noqa: F401

    scored = la.times(emb, c.T).withColumnRenamed("v", "s")
    best = F.array_position("s", F.array_max("s")).cast("int") - 1
    return emb.join(scored.select("entity_id", best.alias("community")), "entity_id")


def spectral_communities(emb: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return kmeans(la.normalize(la.thin_svd(la.normalize(emb, "l2"), k), "l2"), k, seed=seed)


def louvain(graph: HyperGraph, resolution: float = 1.0, passes: int = 50, most_edges: int = 20_000_000) -> DataFrame:
    """(entity_id, community): one level of local moves in entity order, unit weights. Sequential by nature, so on the driver, size checked."""
    adj = adjacency(graph)
    if adj.count() > most_edges:
        raise ValueError("too many edges for sequential moves; use label propagation or k-means")
    ids = [r[0] for r in graph.entities.select("entity_id").orderBy("entity_id").collect()]
    at = {e: i for i, e in enumerate(ids)}
    nb: list[list[int]] = [[] for _ in ids]
    for s, d in adj.orderBy("src", "dst").toLocalIterator():
        nb[at[s]].append(at[d])
    deg = [len(x) for x in nb]
    m = sum(deg) / 2
    own, sigma = list(range(len(ids))), list(map(float, deg))
    for _ in range(passes if m else 0):
        moved = False
        for i, near in enumerate(nb):
            inside: dict[int, int] = {}
            for j in near:
                if j != i:
                    inside[own[j]] = inside.get(own[j], 0) + 1
            old = own[i]
            sigma[old] -= deg[i]
            gain = lambda c: inside.get(c, 0) / m - resolution * deg[i] * sigma[c] / (2 * m * m)  # noqa: B023, E731
            best = max(inside, key=gain, default=old)
            if best != old and gain(best) - gain(old) > 0:
                own[i], moved = best, True
            sigma[own[i]] += deg[i]
        if not moved:
            break
    names: dict[int, int] = {}
    rows = [(e, names.setdefault(own[i], len(names))) for i, e in enumerate(ids)]
    return adj.sparkSession.createDataFrame(rows, "entity_id string, community int")


def modularity(graph: HyperGraph, communities: DataFrame) -> DataFrame:
    """One row: over directed non-loop edges inside a community, the sum of 1 - d_i d_j / W, over W. Unknown entities are in community 0."""
    half = durable(half_adjacency(graph), "adj")
    deg = half_degrees(half)
    info = durable(deg.join(communities.select(F.col("entity_id").alias("src"), F.col("community").alias("c")), "src", "left").select("src", "d", F.coalesce("c", F.lit(0)).alias("c")), "info")
    j = half.join(info, "src").join(info.select(F.col("src").alias("dst"), F.col("d").alias("e"), F.col("c").alias("k")), "dst")
    w = info.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("w"))
    s = j.where(F.col("c") == F.col("k")).agg((2 * F.count(F.lit(1))).alias("n"), F.coalesce(2 * F.sum(F.col("d") * F.col("e")), F.lit(0)).alias("p"))
    return s.crossJoin(w).select(F.when(F.col("w") > 0, (F.col("n") - F.col("p") / F.col("w")) / F.col("w")).otherwise(F.lit(0.0)).alias("modularity"))


def label_propagation(graph: HyperGraph, labels: DataFrame, num_iterations: int = 30, alpha: float = 0.5, every: int = 5) -> DataFrame:
    """(entity_id, label): F = alpha D^-1 A F + (1 - alpha) Y with labelled rows reset, argmax; ties and unreached take the first class.

    Scores are sparse (entity, class) rows, so memory grows with what is reached, not with entities times classes.
    """
    adj = durable(adjacency(graph), "adj")
    deg = adj.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    step = durable(adj.join(deg, "src").select("src", "dst", (alpha / F.col("d")).alias("w")), "step")
    y = durable(labels.select("entity_id", "label", F.lit(1.0).alias("f")), "y")
    f = y
    for it in range(num_iterations):
        spread = step.join(f.select(F.col("entity_id").alias("dst"), "label", "f"), "dst").groupBy(F.col("src").alias("entity_id"), "label").agg(F.sum(F.col("w") * F.col("f")).alias("f"))
        f = spread.join(y.select("entity_id"), "entity_id", "left_anti").unionByName(y)
        if it % every == every - 1:
            f = durable(f, "lp")
    best = f.withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("f"), "label"))).where((F.col("k") == 1) & (F.col("f") > 0))
    first = labels.agg(F.min("label").alias("first"))
    return graph.entities.select("entity_id").join(best.select("entity_id", "label"), "entity_id", "left").crossJoin(F.broadcast(first)).select("entity_id", F.coalesce("label", "first").alias("label"))


def split_labels(labels: DataFrame, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """labels with part: the first int(n ratio) by hashed order are train."""
    n = labels.count()
    cut = labels.select(F.xxhash64(F.lit(seed), "entity_id").alias("u")).orderBy("u").limit(max(1, int(n * train_ratio))).agg(F.max("u")).first()[0]
    return labels.withColumn("part", F.when(F.xxhash64(F.lit(seed), "entity_id") <= (cut if cut is not None else 0), "train").otherwise("test"))


def label_propagation_predict(graph: HyperGraph, labels: DataFrame, num_iterations: int = 30, alpha: float = 0.5, train_ratio: float = 0.8, seed: int = 42) -> dict:
    parts = durable(split_labels(labels, train_ratio, seed), "parts")
    got = label_propagation(graph, parts.where(F.col("part") == "train").select("entity_id", "label"), num_iterations, alpha)
    j = parts.where(F.col("part") == "test").select("entity_id", F.col("label").alias("truth")).join(got, "entity_id")
    return {"accuracy": j.agg(F.avg((F.col("truth") == F.col("label")).cast("double"))).first()[0] or 0.0}


def _onehot(y: np.ndarray, k: int) -> np.ndarray:
    return np.eye(k)[y]


def mlp_classify(emb: DataFrame, labels: DataFrame, hidden_dim: int = 64, learning_rate: float = 0.01, num_epochs: int = 200, train_ratio: float = 0.8, seed: int = 42, l2_reg: float = 1e-4) -> dict:
    """A two-layer ReLU softmax network on the labelled rows, which must fit the driver (size checked); accuracy and macro F1 on the rest."""
    rows = durable(emb.join(split_labels(labels, train_ratio, seed), "entity_id"), "mlp")
    ids, x = la.to_local(rows.select("entity_id", "v"))
    info = {r["entity_id"]: (r["label"], r["part"]) for r in rows.select("entity_id", "label", "part").collect()}
    classes = sorted({v[0] for v in info.values()})
    y = np.array([classes.index(info[e][0]) for e in ids])
    train = np.array([info[e][1] == "train" for e in ids])
    rng = np.random.default_rng(seed)
    k, d = len(classes), x.shape[1]
    w1, w2 = rng.standard_normal((d, hidden_dim)) * np.sqrt(2 / d), rng.standard_normal((hidden_dim, k)) * np.sqrt(2 / hidden_dim)
    b1, b2 = np.zeros(hidden_dim), np.zeros(k)
    at = np.flatnonzero(train)
    for _ in range(num_epochs):
        order = rng.permutation(at)
        for s in range(0, len(order), 256):
            b = order[s : s + 256]
            h = np.maximum(x[b] @ w1 + b1, 0)
            p = _softmax(h @ w2 + b2)
            g = (p - _onehot(y[b], k)) / len(b)
            gh = (g @ w2.T) * (h > 0)
            w2 -= learning_rate * (h.T @ g + l2_reg * w2)
            b2 -= learning_rate * g.sum(0)
            w1 -= learning_rate * (x[b].T @ gh + l2_reg * w1)
            b1 -= learning_rate * gh.sum(0)
    pred = (np.maximum(x @ w1 + b1, 0) @ w2 + b2).argmax(1)
    return _report(y[~train], pred[~train], k, int(train.sum()))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _report(y: np.ndarray, pred: np.ndarray, k: int, train_size: int) -> dict:
    f1 = []
    for c in range(k):
        tp, fp, fn = int(((pred == c) & (y == c)).sum()), int(((pred == c) & (y != c)).sum()), int(((pred != c) & (y == c)).sum())
        f1.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return {"accuracy": float((y == pred).mean()) if len(y) else 0.0, "macro_f1": float(np.mean(f1)) if f1 else 0.0, "num_classes": k, "train_size": train_size, "test_size": len(y)}


def gcn_classify(graph: HyperGraph, emb: DataFrame, labels: DataFrame, hidden_dim: int = 64, learning_rate: float = 0.01, num_epochs: int = 200, train_ratio: float = 0.8, seed: int = 42, l2_reg: float = 1e-4, num_layers: int = 2) -> dict:
    """A graph convolution network on D^-1/2 (A + I) D^-1/2; products with the adjacency run in Spark, weights sit on the driver."""
    adj = adjacency(graph).withColumn("w", F.lit(1.0))
    loops = graph.entities.select(F.col("entity_id").alias("src"), F.col("entity_id").alias("dst"), F.lit(1.0).alias("w"))
    a = adj.unionByName(loops)
    deg = a.groupBy("src").agg(F.sum("w").alias("s"))
    a = a.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("s").alias("t")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("s") * F.col("t"))).alias("w"))
    ids, x = la.to_local(emb)
    op = la.SparseOperator(a, ids)
    info = {r["entity_id"]: (r["label"], r["part"]) for r in split_labels(labels, train_ratio, seed).collect()}
    classes = sorted({v[0] for v in info.values()})
    known = np.array([e in info for e in ids])
    y = np.array([classes.index(info[e][0]) if e in info else 0 for e in ids])
    train = known & np.array([e in info and info[e][1] == "train" for e in ids])
    rng = np.random.default_rng(seed)
    dims = [x.shape[1], *[hidden_dim] * (num_layers - 1), len(classes)]
    ws = [rng.standard_normal((p, q)) * np.sqrt(2 / p) for p, q in zip(dims, dims[1:], strict=False)]
    ax = op.dot(x)
    for _ in range(num_epochs):
        acts, h = [ax], ax
        for i, w in enumerate(ws):
            z = h @ w
            if i < len(ws) - 1:
                h = op.dot(np.maximum(z, 0))
                acts.append(h)
        g = np.where(train[:, None], _softmax(z) - _onehot(y, len(classes)), 0) / max(1, train.sum())
        for i in range(len(ws) - 1, -1, -1):
            gw = acts[i].T @ g + l2_reg * ws[i]
            if i:
                g = op.t_dot(g @ ws[i].T) * (acts[i] != 0)
            ws[i] -= learning_rate * gw
    op.close()
    test = known & ~train
    return _report(y[test], z.argmax(1)[test], len(classes), int(train.sum()))
