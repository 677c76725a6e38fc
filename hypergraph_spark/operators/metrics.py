"""Evaluation metrics over DataFrames of scores, labels and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.operators import linalg as la
from hypergraph_spark.operators.embed import durable


def pair_scores(emb: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with score, the cosine; pairs of unknown entities are dropped."""
    a = emb.select(F.col("entity_id").alias("src"), F.col("v").alias("a"))
    b = emb.select(F.col("entity_id").alias("dst"), F.col("v").alias("b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", la.cosine(F.col("a"), F.col("b"))).drop("a", "b")


def auc(scored: DataFrame) -> DataFrame:
    """One row: area under the ROC curve of (score, positive 0/1) by average ranks, so ties count half.

    Only the distinct scores are put in order, in ranges, with their counts.
    """
    g = scored.groupBy("score").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("n"))
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("b", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return g.agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def ranking(scored: DataFrame, ks: tuple[int, ...] = (1, 3, 10, 50)) -> DataFrame:
    """One row: MRR and hits@k of (query, score, positive); a positive's rank is one plus its query's negatives at or above it.

    Distinct scores are put in order once, in ranges by query and score, and negatives are summed up inside each range
    on top of the ranges before it: no pair of a positive and a negative is made, and no task holds a whole query.
    """
    g = scored.groupBy("query", "score").agg(F.sum((F.col("positive") == 1).cast("long")).alias("p"), F.sum((F.col("positive") == 0).cast("long")).alias("n"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = durable(g.repartitionByRange(parts, "query", F.desc("score")).withColumn("part", F.spark_partition_id()), "ranking")
    before = Window.partitionBy("query").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = g.groupBy("query", "part").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    upto = Window.partitionBy("query", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    r = g.withColumn("own", F.sum("n").over(upto)).where(F.col("p") > 0)
    r = r.join(offsets.select(F.col("query").alias("q"), F.col("part").alias("t"), "before"), F.col("query").eqNullSafe(F.col("q")) & (F.col("part") == F.col("t")))
    # A positive without a score or a query has no negative above it, and a negative without one is above none.
    known = F.col("score").isNotNull() & F.col("query").isNotNull()
    r = r.select("p", F.when(known, 1 + F.col("own") + F.col("before")).otherwise(F.lit(1)).alias("r"))
    mean = lambda x: F.sum(x * F.col("p")) / F.sum("p")
    return r.agg(mean(1 / F.col("r")).alias("mrr"), *[mean((F.col("r") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks])


def link_prediction_scores(emb: DataFrame, test: DataFrame, negative: DataFrame) -> dict:
    """AUC, MRR, hits@k and the share of positives above the median negative."""
    pos = pair_scores(emb, test).select("score", F.lit(1).alias("positive"))
    neg = pair_scores(emb, negative).select("score", F.lit(0).alias("positive"))
    scored = pos.unionByName(neg).cache()
    out = {"auc": auc(scored).first()[0]} | ranking(scored.withColumn("query", F.lit(0))).first().asDict()
    median = scored.where(F.col("positive") == 0).agg(F.percentile("score", F.lit(0.5))).first()[0]
    out["average_precision"] = scored.where(F.col("positive") == 1).agg(F.avg((F.col("score") > median).cast("double"))).first()[0]
    scored.unpersist()
    return out


def centroids(emb: DataFrame, labels: DataFrame) -> DataFrame:
    j = emb.join(labels.select("entity_id", "label"), "entity_id")
    return j.groupBy("label").agg(Summarizer.mean(array_to_vector("v")).alias("m")).select("label", vector_to_array("m").alias("c"))


def centroid_classify(emb: DataFrame, train: DataFrame) -> DataFrame:
    """(entity_id, predicted): the label of the nearest centroid by cosine, ties to the smaller label. Centroids, one a class, are broadcast."""
    j = emb.crossJoin(F.broadcast(centroids(emb, train)))
    best = F.max_by("label", F.struct(la.cosine(F.col("v"), F.col("c")), -F.col("label")))
    return j.groupBy("entity_id").agg(best.alias("predicted"))


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, predicted, n)."""
    return truth.join(predicted, "entity_id").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def f1_scores(conf: DataFrame) -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1 of (label, predicted, n)."""
    t = conf.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = conf.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    s = t.join(p, "label", "full_outer").select(F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("called", F.lit(0)).alias("called"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("called"))
    return s.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def node_classification_scores(emb: DataFrame, labels: DataFrame, train_ratio: float = 0.8, seed: int = 42) -> dict:
    from hypergraph_spark.operators.community import split_labels

    parts = split_labels(labels, train_ratio, seed)
    test = parts.where(F.col("part") == "test").select("entity_id", "label")
    known = emb.join(test.select("entity_id"), "entity_id", "left_semi")
    cents = centroids(emb, parts.where(F.col("part") == "train"))
    best = F.max_by("label", F.struct(la.cosine(F.col("v"), F.col("c")), -F.col("label")))
    got = known.crossJoin(F.broadcast(cents)).groupBy("entity_id").agg(best.alias("predicted"))
    return f1_scores(confusion(test, got)).first().asDict()


def purity(conf: DataFrame) -> DataFrame:
    """One row: the share of rows in their predicted group's largest label."""
    top = conf.groupBy("predicted").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return top.agg((F.sum("m") / F.sum("s")).alias("purity"))


def nmi(conf: DataFrame) -> DataFrame:
    """One row: mutual information over the mean entropy (natural logarithm), 0 if both entropies are 0."""
    n = conf.agg(F.sum("n").alias("t"))
    a = conf.groupBy("label").agg(F.sum("n").alias("a"))
    b = conf.groupBy("predicted").agg(F.sum("n").alias("b"))
    mi = conf.join(a, "label").join(b, "predicted").crossJoin(n).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    h = lambda df, c, name: df.crossJoin(n).agg(F.sum(-F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))).alias(name))
    j = mi.crossJoin(h(a, "a", "ha")).crossJoin(h(b, "b", "hb"))
    return j.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(F.lit(0.0)).alias("nmi"))


def adjusted_rand_index(conf: DataFrame) -> DataFrame:
    """One row: ARI of (label, predicted, n), 0 if the denominator vanishes."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    i = conf.agg(F.sum(two("n")).alias("i"), F.sum("n").alias("t"))
    a = conf.groupBy("label").agg(F.sum("n").alias("a")).agg(F.sum(two("a")).alias("a"))
    b = conf.groupBy("predicted").agg(F.sum("n").alias("b")).agg(F.sum(two("b")).alias("b"))
    j = i.crossJoin(a).crossJoin(b).withColumn("e", F.col("a") * F.col("b") / (F.col("t") * (F.col("t") - 1) / 2)).withColumn("d", (F.col("a") + F.col("b")) / 2 - F.col("e"))
    return j.select(F.when(F.abs("d") < 1e-10, F.lit(0.0)).otherwise((F.col("i") - F.col("e")) / F.col("d")).alias("ari"))


def silhouette(emb: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean silhouette by cosine distance, a singleton's 0. Exact from per-class sums of unit vectors, without pairs."""
    unit = la.normalize(emb, "l2").join(labels.select("entity_id", "label"), "entity_id")
    sums = unit.groupBy("label").agg(Summarizer.sum(array_to_vector("v")).alias("s"), F.count(F.lit(1)).alias("n")).select(F.col("label").alias("other"), vector_to_array("s").alias("s"), "n")
    j = unit.crossJoin(F.broadcast(sums))
    own = F.col("label") == F.col("other")
    total = la.dot(F.col("v"), F.col("s"))
    mean = F.when(own & (F.col("n") > 1), 1 - (total - la.dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)).when(~own, 1 - total / F.col("n"))
    r = j.select("entity_id", own.alias("own"), mean.alias("m"), F.when(own, F.col("n")).alias("size"))
    r = r.groupBy("entity_id").agg(F.max(F.when(F.col("own"), F.col("m"))).alias("a"), F.min(F.when(~F.col("own"), F.col("m"))).alias("b"), F.max("size").alias("size"))
    top = F.greatest("a", "b")
    s = F.when((F.col("size") == 1) | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return r.agg(F.avg(s).alias("silhouette"))


def intra_similarity(emb: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, similarity): mean pairwise cosine inside each class of two or more, from the norm of the class's sum."""
    unit = la.normalize(emb, "l2").join(labels.select("entity_id", "label"), "entity_id")
    g = unit.groupBy("label").agg(Summarizer.sum(array_to_vector("v")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(la.dot(F.col("v"), F.col("v"))).alias("q")).where(F.col("n") > 1)
    g = g.withColumn("s", vector_to_array("s"))
    return g.select("label", ((la.dot(F.col("s"), F.col("s")) - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def ranked_gains(scored: DataFrame, k: int) -> DataFrame:
    """(query, rank, hit) of the k best (query, item, score, hit), ties by item."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "hit")


def map_at_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean over queries of the average precision at k, over min(relevant, k)."""
    total = scored.groupBy("query").agg(F.sum("hit").alias("t")).where(F.col("t") > 0)
    seen = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    g = ranked_gains(scored, k).withColumn("c", F.sum("hit").over(seen))
    ap = g.groupBy("query").agg(F.sum(F.col("hit") * F.col("c") / F.col("rank")).alias("s"))
    return total.join(ap, "query").agg(F.avg(F.col("s") / F.least(F.col("t"), F.lit(k))).alias("map_at_k"))


def ndcg_at_k(scored: DataFrame, k: int = 10) -> DataFrame:
    total = scored.groupBy("query").agg(F.sum("hit").alias("t")).where(F.col("t") > 0)
    dcg = ranked_gains(scored, k).groupBy("query").agg(F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("d"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("t"), F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return total.join(dcg, "query").agg(F.avg(F.col("d") / ideal).alias("ndcg_at_k"))


def cross_validate(emb: DataFrame, labels: DataFrame, k_folds: int = 5, seed: int = 42) -> dict:
    """Mean and deviation of the centroid classifier's scores over hashed folds."""
    import numpy as np

    folds = labels.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "entity_id"), F.lit(k_folds)))
    got = []
    for f in range(k_folds):
        train, test = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f).select("entity_id", "label")
        pred = centroid_classify(emb, train)
        got.append(f1_scores(confusion(test, pred)).first().asDict())
    return {f"{m}_{s.__name__}": float(s([g[m] or 0.0 for g in got])) for m in got[0] for s in (np.mean, np.std)}
