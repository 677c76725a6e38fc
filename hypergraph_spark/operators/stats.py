"""Graph statistics on the undirected 0/1 adjacency (adj: src, dst, both directions, no self-loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.operators.embed import durable
from hypergraph_spark.plans.graph import HyperGraph, adjacency, half_adjacency, half_degrees


def node_degrees(graph: HyperGraph) -> DataFrame:
    """(entity_id, degree), isolated entities with 0."""
    d = half_degrees(half_adjacency(graph)).select(F.col("src").alias("entity_id"), F.col("d").alias("degree"))
    return graph.entities.select("entity_id").join(d, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_distribution(graph: HyperGraph) -> DataFrame:
    """(degree, count) for every degree from 0 to the largest; (0, 0) for an empty graph."""
    seen = node_degrees(graph).groupBy("degree").agg(F.count(F.lit(1)).alias("count"))
    top = seen.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("m"))
    every = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("degree"))
    return every.join(seen, "degree", "left").select("degree", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def by_degree(half: DataFrame) -> DataFrame:
    """(src, d, i): entities with a neighbour, numbered in order of degree, then name."""
    return half_degrees(half).orderBy("d", "src").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("src string, d long, i int")


def triangles(half: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(entity_id, triangles) of half (src < dst).

    Edges go from lower to higher degree, which bounds an entity's list of ends by sqrt(2 edges). An edge carries what
    follows its end in the list, as numbers, to the end's own list; both are intersected inside a row, so wedges are
    never rows.
    """
    order = durable(by_degree(half), "order") if order is None else order
    a = half.join(order.select("src", F.col("i").alias("a")), "src").join(order.select(F.col("src").alias("dst"), F.col("i").alias("b")), "dst")
    up = a.groupBy(F.least("a", "b").alias("x")).agg(F.array_sort(F.collect_list(F.greatest("a", "b"))).alias("up"))
    lists = durable(up, "up")
    sent = lists.select("x", "up", F.posexplode("up").alias("p", "y")).select("x", "y", F.slice("up", F.col("p") + 2, F.size("up")).alias("rest")).where(F.size("rest") > 0)
    met = sent.join(lists.select(F.col("x").alias("y"), F.col("up").alias("own")).hint("shuffle_hash"), "y")
    met = met.select("x", "y", F.array_intersect("rest", "own").alias("z")).where(F.size("z") > 0)
    count = lambda e, n: F.struct(e.alias("i"), n.alias("n"))
    counts = F.concat(F.array(count(F.col("x"), F.size("z")), count(F.col("y"), F.size("z"))), F.transform("z", lambda z: count(z, F.lit(1))))
    n = met.select(F.explode(counts).alias("c")).select("c.*").groupBy("i").agg(F.sum("n").alias("triangles"))
    return n.join(order, "i").select(F.col("src").alias("entity_id"), "triangles")


def clustering_coefficient(graph: HyperGraph) -> DataFrame:
    """One row: the mean of 2 T / (d (d - 1)) over entities of degree 2 or more, 0 if there is none."""
    half = durable(half_adjacency(graph), "adj")
    order = durable(by_degree(half), "order")
    d = order.where(F.col("d") >= 2).select(F.col("src").alias("entity_id"), "d")
    c = d.join(triangles(half, order), "entity_id", "left").select((2 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("c"))
    return c.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("clustering_coefficient"))


def connected_components(graph: HyperGraph, most_rounds: int = 100) -> DataFrame:
    """(entity_id, component): the smallest entity reachable, by min-label rounds with pointer jumping, each written out."""
    adj = durable(adjacency(graph), "adj")
    label = durable(graph.entities.select("entity_id", F.col("entity_id").alias("component")), "cc")
    for _ in range(most_rounds):
        near = adj.join(label.select(F.col("entity_id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("entity_id")).agg(F.min("component").alias("c"))
        new = label.join(near, "entity_id", "left").select("entity_id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("entity_id").alias("component"), F.col("component").alias("further"))
        new = durable(new.join(jump, "component", "left").select("entity_id", F.least("component", F.coalesce("further", "component")).alias("component"), "old"), "cc")
        changed = not new.where(F.col("component") != F.col("old")).isEmpty()
        label = new.select("entity_id", "component")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def largest_component(graph: HyperGraph) -> DataFrame:
    """(entity_id) of the largest component, the first by name among equals."""
    cc = connected_components(graph)
    top = cc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return cc.join(F.broadcast(top.select("component")), "component", "left_semi").select("entity_id")


def bfs(adj: DataFrame, sources: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(source, entity_id, hops) of everything reachable from sources (entity_id); all sources advance together."""
    seen = durable(sources.select(F.col("entity_id").alias("source"), "entity_id", F.lit(0).alias("hops")), "bfs")
    front, hop = seen, 0
    while most_hops is None or hop < most_hops:
        hop += 1
        step = front.join(adj, F.col("entity_id") == F.col("src")).select("source", F.col("dst").alias("entity_id")).distinct()
        front = durable(step.join(seen, ["source", "entity_id"], "left_anti").select("source", "entity_id", F.lit(hop).alias("hops")), "bfs")
        if front.isEmpty():
            break
        seen = durable(seen.unionByName(front), "bfs")
    return seen


def diameter(graph: HyperGraph, approx: bool = False, most_nodes: int = 50_000) -> int:
    """Largest distance in the largest component; approx: two sweeps from one entity, a lower bound exact on trees."""
    nodes = durable(largest_component(graph), "lcc")
    n = nodes.count()
    if n <= 1:
        return 0
    adj = durable(adjacency(graph).join(nodes.select(F.col("entity_id").alias("src")), "src", "left_semi"), "adj")
    if approx:
        far = nodes.orderBy("entity_id").limit(1)
        for _ in range(2):
            out = bfs(adj, far)
            top = out.orderBy(F.desc("hops"), "entity_id").limit(1)
            far = durable(top.select("entity_id"), "far")
        return top.first()["hops"]
    if n > most_nodes:
        raise ValueError("too many nodes for all pairs; use approx=True")
    return bfs(adj, nodes).agg(F.max("hops")).first()[0]


def fold_leaves(graph: HyperGraph, most_rounds: int = 32) -> tuple[DataFrame, DataFrame]:
    """(state, adj): entities (v, w, q) with the branches folded into them, and what is left of the adjacency.

    A round removes all entities of one neighbour and adds their weight w, the entities they stand for, to that
    neighbour; q adds up the squares of the branches' weights. Of two that are each other's only neighbour the smaller goes.
    """
    adj = durable(adjacency(graph), "adj")
    state = durable(graph.entities.select(F.col("entity_id").alias("v"), F.lit(1.0).alias("w"), F.lit(0.0).alias("q")), "fold")
    for _ in range(most_rounds):
        ends = adj.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("up")).where(F.col("n") == 1).select(F.col("src").alias("v"), "up")
        leaves = ends.join(ends.select(F.col("v").alias("up"), F.lit(True).alias("too")), "up", "left").where(F.col("too").isNull() | (F.col("v") < F.col("up"))).select("v", "up")
        leaves = durable(leaves, "leaves")
        if leaves.isEmpty():
            break
        gain = leaves.join(state, "v").groupBy(F.col("up").alias("v")).agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"))
        none = F.lit(0.0)
        state = durable(state.join(gain, "v", "left").select("v", (F.col("w") + F.coalesce("s", none)).alias("w"), (F.col("q") + F.coalesce("s2", none)).alias("q")), "fold")
        gone = leaves.select("v")
        adj = durable(adj.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"), "adj")
    return state, adj


def betweenness_centrality(graph: HyperGraph, top_k: int | None = 10, batch: int = 256, most_nodes: int = 50_000) -> DataFrame:
    """(entity_id, betweenness): exact, unnormalised, pairs counted once.

    Branches that hang on one entity are folded first and counted by their sizes; only what is left, of most_nodes
    entities at most, is searched from every entity, in batches of joins, entities weighing what they stand for.
    """
    state, adj = fold_leaves(graph)
    adj = durable(adj.join(state.select(F.col("v").alias("dst"), F.col("w").alias("wd")), "dst").select("src", "dst", "wd"), "adj")
    core = adj.select(F.col("src").alias("v")).distinct()
    left = core.join(state, "v").select("v", "w").orderBy("v").limit(most_nodes + 1).collect()
    if len(left) > most_nodes:
        raise ValueError("too many nodes for exact betweenness")
    names, weight = [r["v"] for r in left], {r["v"]: r["w"] for r in left}
    spark, total = adj.sparkSession, None
    for i in range(0, len(names), batch):
        src = spark.createDataFrame([(x,) for x in names[i : i + batch]], "entity_id string")
        ws = F.broadcast(spark.createDataFrame([(x, weight[x]) for x in names[i : i + batch]], "s string, ws double"))
        levels = [durable(src.select(F.col("entity_id").alias("s"), F.col("entity_id").alias("v"), F.lit(1.0).alias("sigma")), "bc")]
        seen = levels[0].select("s", "v")
        while True:
            nxt = levels[-1].join(adj, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"), "sigma").join(seen, ["s", "v"], "left_anti").groupBy("s", "v").agg(F.sum("sigma").alias("sigma"))
            nxt = durable(nxt, "bc")
            if nxt.isEmpty():
                break
            levels.append(nxt)
            seen = durable(seen.unionByName(nxt.select("s", "v")), "bc")
        delta = levels[-1].select("s", "v", "sigma", F.lit(0.0).alias("delta"))
        for upper in reversed(levels[:-1]):
            got = delta.where(F.col("s") != F.col("v")).join(ws, "s").select("s", "v", (F.col("delta") * F.col("ws")).alias("delta"))
            total = got if total is None else total.unionByName(got)
            give = delta.withColumnRenamed("v", "w").join(adj, F.col("w") == F.col("dst")).select("s", F.col("src").alias("v"), ((F.col("wd") + F.col("delta")) / F.col("sigma")).alias("share"))
            back = upper.join(give, ["s", "v"], "left").groupBy("s", "v", "sigma").agg((F.coalesce(F.sum("share"), F.lit(0.0))).alias("sh"))
            delta = durable(back.select("s", "v", "sigma", (F.col("sigma") * F.col("sh")).alias("delta")), "bc")
        total = durable(total.groupBy("v").agg(F.sum("delta").alias("delta")).select(F.lit("").alias("s"), "v", "delta"), "bc") if total is not None else None
    if total is None:
        total = spark.createDataFrame([], "s string, v string, delta double")
    cc = durable(connected_components(graph), "cc")
    sizes = cc.join(cc.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component").select(F.col("entity_id").alias("v"), "n")
    own, inside = F.col("w") - 1, total.groupBy("v").agg((F.sum("delta") / 2).alias("b"))
    # Pairs of two branches, of a branch and what lies beyond the entity, and of two others.
    value = (own * own - F.col("q")) / 2 + own * (F.col("n") - F.col("w")) + F.coalesce("b", F.lit(0.0))
    out = state.join(sizes, "v").join(inside, "v", "left").select(F.col("v").alias("entity_id"), value.alias("betweenness"))
    return out if top_k is None else out.orderBy(F.desc("betweenness"), "entity_id").limit(top_k)


def pagerank(graph: HyperGraph, top_k: int | None = 10, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(entity_id, pagerank): damped ranks on adj, the mass of entities without neighbours spread evenly, until the L1 change is under tol."""
    n = graph.num_entities()
    deg = durable(node_degrees(graph), "deg")
    adj = durable(adjacency(graph).join(deg.where(F.col("degree") > 0).withColumnRenamed("entity_id", "src"), "src"), "adj")
    rank = deg.select("entity_id", "degree", F.lit(1.0 / max(1, n)).alias("r"))
    for _ in range(max_iter):
        into = adj.join(rank.select(F.col("entity_id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("entity_id")).agg(F.sum(F.col("r") / F.col("degree")).alias("m"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("r"))), F.lit(0.0)).alias("loose"))
        new = rank.join(into, "entity_id", "left").crossJoin(F.broadcast(loose)).select("entity_id", "degree", ((1 - damping) / n + damping * (F.coalesce("m", F.lit(0.0)) + F.col("loose") / n)).alias("r"), F.col("r").alias("old"))
        # A round reads the ranks three times, so each round is written.
        new = durable(new, "pr")
        change = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
        rank = new.drop("old")
        if change < tol:
            break
    out = rank.select("entity_id", F.col("r").alias("pagerank"))
    return out if top_k is None else out.orderBy(F.desc("pagerank"), "entity_id").limit(top_k)


def graph_summary(graph: HyperGraph) -> dict:
    n, m = graph.num_entities(), 2 * half_adjacency(graph).count()
    return {
        "num_nodes": n, "num_edges": m // 2, "density": m / (n * (n - 1)) if n > 1 else 0.0, "avg_degree": m / n if n else 0.0,
        "clustering_coefficient": clustering_coefficient(graph).first()[0], "num_components": connected_components(graph).select("component").distinct().count(),
    }
