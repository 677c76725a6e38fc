import numpy as np
import pytest

from hypergraph_spark import queries
from hypergraph_spark.functions.hashing import init_matrix, init_vector
from hypergraph_spark.operators import algorithms as alg
from hypergraph_spark.operators import community as com
from hypergraph_spark.operators import embed as em
from hypergraph_spark.operators import linalg as la
from hypergraph_spark.operators import preprocess as pre
from hypergraph_spark.operators import similarity as sim
from hypergraph_spark.operators import stats as st
from hypergraph_spark.plans.graph import HyperGraph, build_graph, graph_from_lines, half_adjacency
from hypergraph_spark.plans.spec import parse_spec, relations, single_relation
from hypergraph_spark.sources import lines as src
from hypergraph_spark.sources.generators import barabasi_albert, community_graph, erdos_renyi, planted_partition, watts_strogatz
from hypergraph_spark.sources.io import load_embeddings, save_embeddings
from hypergraph_spark.streaming.micro_batch import IncrementalGraph, embed_streaming

NODE = "complex::reflexive::n"


def lines(spark, *values):
    return em.lines_of(spark, values)


def weights(graph, col):
    return {(r["src"], r["dst"]): r[col] for r in graph.edges.collect()}


def close(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k


def test_spec():
    assert single_relation(parse_spec("Complex::REFLEXIVE::n")) == (0, 0)
    assert single_relation(parse_spec("u complex::p")) == (0, 1)
    for bad in ("n", "a b c", "a complex::reflexive::b"):
        with pytest.raises(ValueError, match="More than one relation"):
            single_relation(parse_spec(bad))
    for bad in ("reflexive::n", "what::n", "transient::n"):
        with pytest.raises(ValueError):
            parse_spec(bad)
    legacy = parse_spec("a complex::reflexive::b transient::c transient::d", legacy=True)
    assert relations(legacy) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 1)]


def test_line_grammar(spark):
    df = lines(spark, "a  b", " a, b ", "a b\tc", "")
    got = [r[0] for r in df.select(src.parse_line(df["value"])).collect()]
    assert got == [[["a", "", "b"]], [["a"], ["b"]], [["a", "b"], ["c"]], [[""]]]
    assert src.hyperedges(df, NODE).count() == 2  # the two-cell lines do not fit
    plain = src.hyperedges(lines(spark, "a b\tc d"), "x complex::y").first()
    assert plain["a"] == ["a"] and plain["b"] == ["c", "d"]


def test_reflexive(spark):
    g = graph_from_lines(lines(spark, "a b", "a c", "a b c"), NODE)
    close(weights(g, "left_w"), {("a", "a"): 0.458333, ("a", "b"): 0.270833, ("a", "c"): 0.270833, ("b", "a"): 0.433333, ("c", "a"): 0.433333, ("b", "b"): 0.433333, ("c", "c"): 0.433333, ("b", "c"): 0.133333, ("c", "b"): 0.133333})
    close(weights(g, "sym_w"), {("a", "a"): 0.458333, ("a", "b"): 0.342580, ("a", "c"): 0.342580, ("b", "a"): 0.342580, ("c", "a"): 0.342580, ("b", "b"): 0.433333, ("c", "c"): 0.433333, ("b", "c"): 0.133333, ("c", "b"): 0.133333})
    close({r[0]: r[1] for r in g.degrees().collect()}, {"a": 8 / 3, "b": 5 / 3, "c": 5 / 3})


def test_bipartite_and_mask(spark):
    g = graph_from_lines(lines(spark, "u1\tp1 p2", "u2\tp2 p3 p4"), "u complex::p")
    close(weights(g, "left_w"), {("u1", "p1"): 1, ("u1", "p2"): 1, ("u2", "p2"): 1, ("u2", "p3"): 1, ("u2", "p4"): 1, ("p1", "u1"): 0.5, ("p2", "u1"): 0.25, ("p2", "u2"): 0.166667, ("p3", "u2"): 0.333333, ("p4", "u2"): 0.333333})
    assert {r[0] for r in g.column_mask("u").collect() if r[1]} == {"u1", "u2"}
    assert not any(r[1] for r in graph_from_lines(lines(spark, "a b"), NODE).column_mask("n").collect())
    with pytest.raises(ValueError):
        g.column_mask("x")
    with pytest.raises(ValueError):
        g.weight("right")


def test_repeats_and_trim(spark):
    g = graph_from_lines(lines(spark, "x x y"), NODE)
    close(weights(g, "value"), {("x", "x"): 0.888889, ("x", "y"): 0.444444, ("y", "x"): 0.444444, ("y", "y"): 0.222222})
    t = graph_from_lines(lines(spark, "a b", "a b c d"), NODE, trim_n=2)
    e = weights(t, "value")
    assert ("c", "d") not in e and ("c", "c") not in e and e["c", "a"] == pytest.approx(2 / 16)


def test_init():
    import xxhash

    keys = np.array([xxhash.xxh64_intdigest(x) for x in (b"a", b"alice", b"0", b"")], np.uint64)
    assert [f"{k:016x}" for k in keys.tolist()] == ["d24ec4f1a98c6e5b", "73a3ea485f2e6049", "633457081244afec", "ef46db3751d8e999"]
    m = init_matrix(keys, 3, 0)
    assert m[0].tolist() == [-0.736054539680481, 0.5298933982849121, 0.7958413362503052]
    assert m[3].tolist() == [0.39013826847076416, 0.6560862064361572, -0.07796585559844971]
    assert init_matrix(keys, 1, 7)[1, 0] == -0.2407665252685547


def test_embed_against_numpy(spark):
    g = graph_from_lines(lines(spark, "a b", "b c d", "d e", "a e f", "f g"), NODE).cache()
    ids = sorted(r[0] for r in g.entities.collect())
    p = np.zeros((len(ids), len(ids)))
    for (s, d), w in weights(g, "left_w").items():
        p[ids.index(s), ids.index(d)] = w
    import xxhash

    x = init_matrix(np.array([xxhash.xxh64_intdigest(i.encode()) for i in ids], np.uint64), 3, 0)
    for _ in range(3):
        y = 0.8 * (p @ x) + 0.2 * x
        x = y / np.linalg.norm(y, axis=1, keepdims=True)
    for distributed in (False, True):
        got = dict(em.embed(g, 3, 3, residual_weight=0.2, whiten=False, distributed=distributed).collect())
        assert np.allclose([got[i] for i in ids], x, atol=1e-9)
    early = []
    em.embed(g, 3, 50, whiten=False, convergence_threshold=0.5, callback=lambda i, m: early.append(i))
    assert len(early) < 50
    assert g.entities.select(init_vector(g.entities["entity_id"], 3)).count() == 7


def test_whitening_and_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 4)) @ rng.standard_normal((4, 4)) + 3
    emb = la.to_emb(spark, [f"{i:03d}" for i in range(200)], x)
    _, w = la.to_local(la.whiten(emb))
    assert np.allclose(np.cov(w.T), np.eye(4), atol=1e-8) and np.allclose(w.mean(0), 0)
    _, u = la.to_local(la.thin_svd(emb, 2, centre=True))
    c = x - x.mean(0)
    assert np.allclose(np.linalg.norm(u, axis=0), np.linalg.svd(c, compute_uv=False)[:2])
    m = rng.standard_normal((30, 30)) * (rng.random((30, 30)) < 0.3)
    uu, s, v = la.randomized_svd(lambda a: m @ a, lambda a: m.T @ a, 30, 30)
    assert np.allclose(uu * s @ v.T, m, atol=1e-8)
    rot, r = sim.procrustes(emb, la.times(emb, np.linalg.qr(rng.standard_normal((4, 4)))[0]))
    assert sim.alignment_score(emb, rot) == pytest.approx(1.0)


def test_search_and_compression(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    ids = [f"{i:02d}" for i in range(60)]
    emb = la.to_emb(spark, ids, x).cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [ids[j] for j in np.argsort(-(u @ u[5]), kind="stable") if j != 5][:4]
    assert [r[0] for r in sim.find_most_similar(emb, "05", 4).collect()] == want
    assert [r[0] for r in sim.ANNIndex(emb, "brute").query("05", 4).collect()] == want
    for method in ("hnsw", "ball_tree"):
        assert [r[0] for r in sim.ANNIndex(emb, method, leaf_rows=8).query("05", 4).collect()] == want
    blocks = sim.similar_by_blocks(emb, emb, 4, block=16).where("source = '05'").orderBy("rank")
    assert [r["target"] for r in blocks.collect()] == want
    pq = sim.product_quantize(emb, 4, 16, 10)
    _, back = la.to_local(pq.reconstruct())
    assert ((back - x) ** 2).mean() < (x**2).mean() / 2
    assert pq.search(x[5], 3).count() == 3
    # With every row a candidate the codes decide nothing, so the result is exact.
    exact = pq.search_all(emb, emb, 4, widen=15, block=16).where("source = '05'").orderBy("rank")
    assert [r["target"] for r in exact.collect()] == want
    for index in (sim.ANNIndex(emb, "brute"), sim.ANNIndex(emb, "ball_tree", leaf_rows=8)):
        every = index.query_all(emb, 4, block=16)
        assert every.count() == 240 and [r["target"] for r in every.where("source = '05'").orderBy("rank").collect()] == want
        assert index.query_all(emb.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        sim.find_most_similar(emb, "nobody")
    with pytest.raises(ValueError):
        sim.search_vector(emb, x[0], 0)


def test_statistics(spark):
    g = graph_from_lines(lines(spark, "a b", "b c", "a c", "c d", "e f"), NODE).cache()
    assert {r[0]: r[1] for r in st.degree_distribution(g).collect()} == {0: 0, 1: 3, 2: 2, 3: 1}
    assert st.clustering_coefficient(g).first()[0] == pytest.approx((1 + 1 + 1 / 3) / 3)
    assert {r[0]: r[1] for r in st.connected_components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    assert st.diameter(g) == 2 and st.diameter(g, approx=True) == 2
    assert {r[0]: r[1] for r in st.betweenness_centrality(g).collect()} == {"a": 0, "b": 0, "c": 2, "d": 0, "e": 0, "f": 0}
    pr = {r[0]: r[1] for r in st.pagerank(g, None, max_iter=60, tol=1e-10).collect()}
    assert sum(pr.values()) == pytest.approx(1.0) and max(pr, key=pr.get) == "c"
    assert st.graph_summary(g)["num_components"] == 2
    assert pre.largest_connected_component(g).num_entities() == 4


def test_preprocess_and_sampling(spark):
    raw = lines(spark, "a b", "b a", " a b ", "c c", "c d", "", "d e")
    assert sorted(r[0] for r in pre.clean_lines(raw).collect()) == ["a b", "c d", "d e"]
    assert sorted(r[0] for r in pre.filter_lines_by_degree(lines(spark, "a b", "b c", "c d"), 2).collect()) == ["b c"]
    assert sorted(r[0] for r in src.remove_lines(raw, lines(spark, "a b")).collect()) == ["", " a b ", "b a", "c c", "c d", "d e"]
    edges = erdos_renyi(spark, 40, 0.2)
    g = graph_from_lines(src.from_table(edges, "src", "dst"), NODE).cache()
    split = {r[0]: r[1] for r in pre.train_test_split_edges(g).groupBy("part").count().collect()}
    m = edges.count()
    assert split == {"train": int(m * 0.8), "test": m - int(m * 0.8)}
    assert pre.sample_nodes(g, 5).count() == 5 and pre.sample_edges(g, 7).count() == 7
    neg = pre.negative_sampling(g, 50)
    assert neg.distinct().count() == 50 and neg.join(g.edges, ["src", "dst"]).count() == 0
    nodes, inside = pre.sample_neighborhood(g, pre.sample_nodes(g, 1), 1, 3)
    assert 1 <= nodes.count() <= 4 and inside.count() % 2 == 0
    for method in ("random_node", "bfs", "random_walk"):
        assert 1 <= pre.sample_subgraph(g, 6, method, 10)[0].count() <= 6
    assert pre.graphsaint_sample(g, 8, 3, 2).select("batch").distinct().count() <= 2
    assert barabasi_albert(spark, 20, 2).count() == 3 + 17 * 2
    assert watts_strogatz(spark, 20, 4)[0].count() > 30
    assert community_graph(spark, 50, 200, 3, feature_dim=4)["features"].count() == 50


def test_communities_find_blocks(spark):
    edges, labels = planted_partition(spark, 2, 15, 0.6, 0.02)
    g = graph_from_lines(src.from_table(edges, "src", "dst"), NODE).cache()
    emb = em.embed(g, 8, 6, whiten=False).cache()
    truth = {r[0]: r[1] for r in labels.collect()}
    for got in (com.kmeans(emb, 2), com.louvain(g)):
        c = {r[0]: r[1] for r in got.collect()}
        pure = sum(max(sum(truth[e] == t for e in c if c[e] == k) for t in (0, 1)) for k in set(c.values())) / len(c)
        assert pure > 0.8
    seeds = labels.where("cast(entity_id as int) % 5 = 0")
    lp = {r[0]: r[1] for r in com.label_propagation(g, seeds, 10).collect()}
    assert np.mean([lp[e] == truth[e] for e in lp]) > 0.8
    assert com.mlp_classify(em.embed(g, 8, 6), labels, num_epochs=50)["test_size"] > 0
    assert com.gcn_classify(g, emb, labels, num_epochs=20)["num_classes"] == 2


def test_spectral_family(spark):
    g = graph_from_lines(lines(spark, "a b", "b c", "c a", "d e", "e f", "f d", "c d"), NODE).cache()
    ids = sorted(r[0] for r in g.entities.collect())
    p = np.zeros((6, 6))
    for (s, d), w in weights(g, "left_w").items():
        p[ids.index(s), ids.index(d)] = w
    m = np.log(np.maximum(p.sum() * (p + p @ p) / 2 / p.sum(1)[:, None] * p.sum(1)[None, :], 1))
    got = {(r[0], r[1]): r[2] for r in alg.netmf_matrix(g, 2).collect()}
    for i, a in enumerate(ids):
        for j, b in enumerate(ids):
            assert got.get((a, b), 0.0) == pytest.approx(m[i, j], abs=1e-9)
    for f in (alg.embed_prone, alg.embed_randne, alg.embed_hope, alg.embed_netmf, alg.embed_grarep):
        _, x = la.to_local(f(g, 4))
        assert x.shape == (6, 4) and np.allclose(np.linalg.norm(x, axis=1), 1)
    walks = alg.random_walks(g, 2, 6, 0.5, 2.0).collect()
    assert len(walks) == 12 and all(len(w["path"]) == 6 for w in walks)
    assert all(p[ids.index(a), ids.index(b)] > 0 and a != b for w in walks for a, b in zip(w["path"], w["path"][1:], strict=False))


def test_save_load_stream(spark, tmp_path):
    g = graph_from_lines(lines(spark, "a b", "b c"), NODE)
    g.save(str(tmp_path / "g"))
    assert weights(HyperGraph.load(spark, str(tmp_path / "g")), "left_w") == weights(g, "left_w")
    emb = em.embed(g, 4, 2, whiten=False)
    for fmt in ("parquet", "csv", "npz"):
        path = str(tmp_path / f"e.{fmt}")
        save_embeddings(emb, path, fmt)
        a, b = dict(emb.collect()), dict(load_embeddings(spark, path, fmt).collect())
        assert all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    inc = IncrementalGraph(NODE)
    inc.add(lines(spark, "a b"))
    close(weights(inc.add(lines(spark, "b c")), "left_w"), weights(g, "left_w"))
    grown, x = embed_streaming([lines(spark, "a b"), lines(spark, "b c d")], NODE, 4, 2)
    assert x.count() == grown.num_entities() == 4


def test_estimator(spark):
    e = em.Embedder(feature_dim=4, num_iterations=2, whiten=False)
    with pytest.raises(RuntimeError):
        e.transform()
    e.set_params(seed=1).fit(lines(spark, "a b", "b c"))
    assert {r[0] for r in e.transform(lines(spark, "a zz")).collect()} == {"a"}
    with pytest.raises(ValueError):
        e.transform(lines(spark, "zz"))
    with pytest.raises(ValueError):
        e.set_params(nope=1)


def test_reduction_keeps_groups_apart(spark):
    from hypergraph_spark.operators.reduce import reduce_dimensions

    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((15, 6)) * 0.1 + c for c in (np.eye(6)[0] * 3, np.eye(6)[1] * 3)])
    emb = la.to_emb(spark, [f"{i:02d}" for i in range(30)], x)
    for method in ("pca", "tsne", "umap"):
        _, y = la.to_local(reduce_dimensions(emb, method))
        assert y.shape == (30, 2) and np.isfinite(y).all()
        a, b = y[:15].mean(0), y[15:].mean(0)
        assert np.linalg.norm(a - b) > np.linalg.norm(y[:15] - a, axis=1).mean()


def test_relations_train_and_save(spark, tmp_path):
    from hypergraph_spark.operators.relations import save_relations, train_relations
    from hypergraph_spark.sources.lines import tsv_rows

    spec = "complex::reflexive::a b transient::c ignore::d"
    cells = tsv_rows(lines(spark, "x y\tk\ts\t1", "x\tl\ts\t2", "short\tline"), spec)
    got = train_relations(cells, spec, feature_dim=4, num_iterations=2)
    assert set(got) == {"a__b", "a__c", "b__c", "a__a"}
    rows = {n: {r["entity_id"]: r["occurrence"] for r in x.collect()} for n, x in got.items()}
    assert set(rows["a__c"]) == {"a__x", "a__y"} and set(rows["b__c"]) == {"b__k", "b__l"}
    # The first line has 2 * 2 products, the second one; x stands in half of the first's and in all of the second's.
    assert rows["a__b"]["a__x"] == 3 and rows["a__b"]["b__k"] == 4
    paths = save_relations({"a__b": got["a__b"]}, str(tmp_path / "n"), fmt="numpy")
    x, occ = np.load(open(paths[0], "rb")), np.load(open(paths[0] + ".occurences", "rb"))
    assert x.shape == (4, 4) and sorted(occ.tolist()) == sorted(rows["a__b"].values())
    text = save_relations({"b__c": got["b__c"]}, str(tmp_path / "t"))[0]
    assert spark.read.text(f"{text}/header").first()[0] == "2 4"
    with pytest.raises(ValueError):
        save_relations(got, str(tmp_path), fmt="other")


def test_hetero_container(spark):
    from hypergraph_spark.operators.hetero import HeteroGraph

    pair = spark.createDataFrame([("1", "2"), ("1", "2"), ("2", "3")], "src string, dst string")
    one = HeteroGraph().add_edge_type("knows", "p", "p", pair)
    assert sorted(map(tuple, one.homogeneous_edges().collect())) == [("1", "2"), ("1", "2"), ("2", "3")]
    two = HeteroGraph().add_edge_type("likes", "p", "q", pair).add_node_type("r")
    assert ("p_1", "q_2") in set(map(tuple, two.homogeneous_edges().collect()))
    assert two.num_nodes("p") == 2 and two.num_nodes("r") == 0 and two.num_nodes() == 4 and two.num_edges() == 3
    assert two.edge_types == ["likes"] and "likes: p -> q, 3 edges" in two.summary()
    with pytest.raises(ValueError):
        two.get_edges("hates")


def test_dataset_files_and_benchmark(spark, tmp_path):
    from hypergraph_spark.operators.embed import embed
    from hypergraph_spark.operators.tuning import benchmark_datasets, format_dataset_table
    from hypergraph_spark.sources.datasets import load_dataset

    (tmp_path / "e.csv").write_text("".join(f"{i},{(i + 1) % 6}\n" for i in range(6)))
    (tmp_path / "l.csv").write_text("0\n0\n0\n1\n1\n1\n")
    (tmp_path / "h.tsv").write_text("SOURCE_SUBREDDIT\tTARGET_SUBREDDIT\tPOST\na\tb\t1\n")
    data = load_dataset(spark, "ogbn_products", str(tmp_path / "e.csv"), str(tmp_path / "l.csv"))
    assert data["edges"].count() == 6 and [r["label"] for r in data["labels"].orderBy("entity_id").collect()] == [0, 0, 0, 1, 1, 1]
    assert [tuple(r) for r in load_dataset(spark, "reddit_hyperlink", str(tmp_path / "h.tsv"))["edges"].collect()] == [("a", "b")]
    out = benchmark_datasets(spark, ["nowhere", "facebook"], lambda g: embed(g, 4, 1), paths={"facebook": str(tmp_path / "h.tsv")})
    assert all("error" in r for r in out.values()) and "nowhere" in format_dataset_table(out)


def test_document_tokens_of_all_lines(spark, tmp_path):
    spark.createDataFrame([("a b\nc d\n",), (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0]: r[1] for r in queries.document_tokens(spark, str(tmp_path)).collect()} == {"a": 0.4, "b": 0.4, "c": 0.4, "d": 0.4, "": 2.4}


def test_betweenness_and_covariance_are_whole(spark, tmp_path):
    g = graph_from_lines(lines(spark, *[f"m l{i}" for i in range(12)]), NODE)
    assert {r[0]: r[1] for r in st.betweenness_centrality(g, top_k=None).collect()} == {"m": 66.0} | {f"l{i}": 0.0 for i in range(12)}
    spark.createDataFrame([(i, [float(i * j % 7) for j in range(12)]) for i in range(9)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i"], r["j"]): r["c"] for r in queries.covariance(spark, str(tmp_path)).collect()}
    want = np.cov([[i * j % 7 for i in range(9)] for j in range(12)])
    assert len(got) == 144 and all(got[i, j] == pytest.approx(want[i, j], abs=1e-5) for i, j in got)


def test_equal_vectors_tie_by_target_in_any_order(spark):
    rng = np.random.default_rng(3)
    ids = [f"{i:03d}" for i in range(60)]
    x = np.array([[1.0, 2.0, 0.5]] * 60)
    for at in (np.arange(60)[::-1], rng.permutation(60)):
        emb = la.to_emb(spark, [ids[i] for i in at], x).coalesce(1)
        got = sim.similar_by_blocks(emb.where("entity_id = '059'"), emb, 5).orderBy("rank").collect()
        assert [r["target"] for r in got] == ids[:5]


def test_best_targets_are_bounded_and_whole():
    rng = np.random.default_rng(3)
    s, ids = rng.integers(0, 9, (5000, 7)) / 8, np.array([f"e{i:04}" for i in range(5000)], object)
    best = sim._Best([f"q{j}" for j in range(7)], 5)
    most = 0
    for lo in range(0, 5000, 250):
        best.add(np.arange(7), s[lo : lo + 250].copy(), ids[lo : lo + 250])
        most = max(most, best.held)
    got = [(r["source"], r["target"], r["score"]) for b in best.batches() for r in b.to_pylist()]
    assert got == [(f"q{j}", ids[i], s[i, j]) for j in range(7) for i in sorted(range(5000), key=lambda i: (-s[i, j], ids[i]))[:5]]
    assert most <= 65_536 + 250 * 7


def test_links_of_a_hub_ask_for_no_more(spark, monkeypatch):
    """Existing links are left out while rows are scored, so the search's size does not follow the largest degree."""
    asked, search = [], sim.similar_by_blocks
    monkeypatch.setattr(sim, "similar_by_blocks", lambda q, x, k: asked.append(k) or search(q, x, k))
    rng = np.random.default_rng(1)
    x = {f"n{i}": rng.standard_normal(4) for i in range(30)}
    g = graph_from_lines(lines(spark, *[f"n0 n{i}" for i in range(1, 25)], "n1 n2"), NODE)
    got = [(r["source"], r["target"]) for r in sim.predict_links(g, la.to_emb(spark, list(x), np.array(list(x.values()))), 4).collect()]
    assert asked == [4]
    cos = lambda a, b: x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])
    linked = {("n0", f"n{i}") for i in range(1, 25)} | {("n1", "n2")}
    new = [(a, b) for a in x for b in x if a != b and (a, b) not in linked and (b, a) not in linked]
    assert got == sorted(new, key=lambda p: (-round(cos(*p), 12), p))[:4]


def test_ball_tree_distances_need_no_cube():
    """Centres to queries: memory of leaves x queries, not times dimensions."""
    import tracemalloc

    tree = sim.BallTree.__new__(sim.BallTree)
    rng = np.random.default_rng(2)
    tree.centres, q = rng.standard_normal((400, 64)), la.local_l2(rng.standard_normal((300, 64)))
    tracemalloc.start()
    away = tree._away(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * away.nbytes and np.allclose(away, np.linalg.norm(tree.centres[:, None] - q[None], axis=2))


def test_pq_fits_on_a_bounded_sample_and_encodes_all(spark):
    x = la.to_emb(spark, [f"e{i}" for i in range(300)], np.random.default_rng(5).standard_normal((300, 8)))
    index = sim.product_quantize(x, 2, 16, 3, sample_rows=100)
    assert index.codes.count() == 300 and index.codebooks.shape == (2, 16, 4)


def test_trim_does_not_depend_on_the_order_tokens_are_collected_in(spark):
    """Each evaluation may collect a hyperedge's tokens in another order."""
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("array<string>")
    def dealt(v: pd.Series) -> pd.Series:
        rng = np.random.default_rng()
        return pd.Series([list(rng.permutation(x)) for x in v])

    rows = [([f"t{(7 * i + k * k) % 23:02}" for k in range(9)],) for i in range(40)]
    df = spark.createDataFrame(rows, "t array<string>")
    want = {(r[0], r[1]): round(r[2], 9) for r in build_graph(df.select(F.col("t").alias("a"), F.col("t").alias("b")), NODE, 3).pairs().collect()}
    loose = df.select(dealt.asNondeterministic()("t").alias("a"))
    got = {(r[0], r[1]): round(r[2], 9) for r in build_graph(loose.select("a", F.col("a").alias("b")), NODE, 3).pairs().collect()}
    assert got == want


def test_half_pairs_hold_the_graph(spark):
    """A reflexive graph sums each pair once: its plan has no more than half the pairs to shuffle, and both directions come out."""
    g = graph_from_lines(lines(spark, "a b c a", "b d", "e"), NODE, 0)
    both = {(r[0], r[1]): r[2] for r in g.pairs().collect()}
    half = {(r[0], r[1]): r[2] for r in g.half_pairs().collect()}
    assert g.half is not None and half == {k: v for k, v in both.items() if k[0] <= k[1]}
    assert all(both[b, a] == v for (a, b), v in both.items()) and g.num_edges() == len(both)
    assert both["a", "a"] == pytest.approx(2 * 4 / 16) and both["a", "c"] == pytest.approx(2 * 2 / 16)


def test_triangles_without_wedges(spark):
    import random

    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(140)} | {(0, k) for k in range(1, 30)}
    g = graph_from_lines(lines(spark, *[f"n{a} n{b}" for a, b in pairs]), NODE)
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(30)}
    t = {f"n{i}": sum(1 for a in near[i] for b in near[i] if a < b and b in near[a]) for i in range(30)}
    df = st.triangles(half_adjacency(g))
    assert {r[0]: r[1] for r in df.collect()} == {k: v for k, v in t.items() if v}
    c = [2 * t[f"n{i}"] / len(near[i]) / (len(near[i]) - 1) for i in range(30) if len(near[i]) > 1]
    assert st.clustering_coefficient(g).first()[0] == pytest.approx(sum(c) / len(c))


def test_ranking_makes_no_pairs(spark):
    """Ranks with ties, queries without negatives or scores; no join of positives and negatives."""
    import random

    from hypergraph_spark.operators import metrics as me

    rng = random.Random(6)
    rows = [(q, rng.choice([None, *map(float, range(12))]), int(rng.random() < 0.4)) for q in (0, 1, 2) for _ in range(60)] + [(3, 1.0, 1), (None, 5.0, 1), (None, 6.0, 0)]
    ranks = [1 + sum(1 for u, t, y in rows if y == 0 and u is not None and u == q and s is not None and t is not None and t >= s) for q, s, p in rows if p == 1]
    out = me.ranking(spark.createDataFrame(rows, "query int, score double, positive int"), (1, 10))
    got = out.first()
    assert got["mrr"] == pytest.approx(np.mean([1 / r for r in ranks])) and got["hits_at_10"] == pytest.approx(np.mean([r <= 10 for r in ranks]))


def test_betweenness_folds_branches(spark):
    """A cycle with branches, an edge and a path; and no bound on what folds away."""
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "e"), ("e", "f"), ("e", "g"), ("b", "h"), ("x", "y"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "t")]
    near: dict[str, set[str]] = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)

    def paths(x, y):
        front = [[x]]
        while front:
            done = [p for p in front if p[-1] == y]
            if done:
                return done
            front = [[*p, z] for p in front for z in near[p[-1]] if z not in p]
        return []

    want = dict.fromkeys(near, 0.0)
    for x in near:
        for y in near:
            if x < y and (found := paths(x, y)):
                for p in found:
                    for z in p[1:-1]:
                        want[z] += 1 / len(found)
    g = graph_from_lines(lines(spark, *[" ".join(p) for p in pairs]), NODE)
    close({r[0]: r[1] for r in st.betweenness_centrality(g, None, most_nodes=4).collect()}, want)


def test_spmm_long_with_known_dims(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 2.0), ("b", "a", 1.0)], "src string, dst string, w double")
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 4.0), ("c", 0, 5.0)], "entity_id string, dim int, x double")
    got = lambda **k: sorted(map(tuple, la.spmm_long(e, x, "w", **k).collect()))
    assert got(dims=2) == got() == [("a", 0, 12.0), ("b", 0, 1.0), ("b", 1, 3.0)]


def test_walk_steps_join_few_rows_in_a_hub(spark):
    """A hub of 500 neighbours of very unlike weights: every draw has one row, a bucket two on average."""
    pairs = [("hub", f"l{i:03d}", 2.0 ** -(i % 40)) for i in range(500)] + [(f"l{i:03d}", "hub", 1.0) for i in range(500)]
    nb = spark.createDataFrame(pairs, "src string, dst string, w double")
    for by in (nb["w"] * 0 + 1, nb["w"]):
        rows = alg.walk_table(nb, by, shares=True).collect()
        hub = sorted((r["b"], r["lo"], r["hi"], r["dst"], r["share"]) for r in rows if r["src"] == "hub")
        assert len(rows) <= 2 * len(pairs) and len({r["dst"] for r in rows}) == 501
        ends = {b: 0.0 for b in range(500)}
        for b, lo, hi, _, _ in hub:  # the rows of a bucket lie end to end, from 0 to 1
            assert lo == ends[b] and hi > lo
            ends[b] = hi
        assert set(ends.values()) == {1.0}
    total = sum(w for s, _, w in pairs if s == "hub")
    for dst, w in (("l000", 1.0), ("l007", 2.0**-7)):
        assert sum(hi - lo for _, lo, hi, d, _ in hub if d == dst) / 500 == pytest.approx(w / total)
        assert all(s == pytest.approx(w / total) for _, _, _, d, s in hub if d == dst)


def test_walks_follow_their_odds(spark):
    """The second step of many walks, against the exact odds."""
    g = graph_from_lines(lines(spark, *(["a b"] * 3), "a c", "b c", "b d", "b d", "d e"), NODE).cache()
    w = {k: v for k, v in weights(g, "left_w").items() if k[0] != k[1]}
    for p, q in ((1.0, 1.0), (0.5, 2.0), (0.1, 0.5)):
        paths = [r["path"] for r in alg.random_walks(g, 3000, 3, p, q).collect()]
        assert len(paths) == 15000
        for start, mid in (("a", "b"), ("d", "b"), ("c", "a")):
            seen = [x[2] for x in paths if x[:2] == [start, mid]]
            odds = {d: (1.0 if p == q == 1 else v * (1 / p if d == start else 1.0 if (start, d) in w else 1 / q)) for (s, d), v in w.items() if s == mid}
            assert set(seen) <= set(odds) and len(seen) > 500
            for d, o in odds.items():
                assert seen.count(d) / len(seen) == pytest.approx(o / sum(odds.values()), abs=0.07)


def test_twins_stand_for_each_other(spark):
    """Five classes of users, four of them many: operators of one of each against dense ones of all."""
    events = [(f"u{i:02d}", e) for i in range(40) for e in [["a"], ["a", "a", "b"], ["b", "c"], ["a", "b", "c", "c"]][i % 4]] + [("x", "c")] * 3
    t = spark.createDataFrame([([u], [e]) for u, e in events], "a array<string>, b array<string>")
    g = build_graph(t, "user event", 0)
    got = {r[0]: r[1] for r in alg.twins(g).collect()}
    assert len(got) == 44 and len(set(got.values())) == 8 and got["u06"] == "u02" and got["x"] == "x"
    ids = sorted(got)
    m = np.zeros((44, 44))
    for (s, d), w in weights(g, "left_w").items():
        m[ids.index(s), ids.index(d)] = w
    by = alg.Quotient(g, 8)
    cells = by.cells(alg.left_markov(g))
    x = np.random.default_rng(0).standard_normal((44, 3))
    for op in (by.operator(cells), by.operator(cells).fetch()):
        assert np.allclose(op.dot(x), m @ x) and np.allclose(op.t_dot(x), m.T @ x) and len(op.ids) == 8
        op.close()
    p2 = (m + m @ m) / 2
    net = np.log(np.maximum(m.sum() * p2 / m.sum(1)[:, None] * m.sum(1)[None, :], 1))
    logs = [np.log(np.maximum(p, 1e-10)) - np.log(1e-10) for p in (m, m @ m)]
    svd = lambda a, k: (lambda u, s, _: u * np.sqrt(s))(*la.randomized_svd(lambda z: a @ z, lambda z: a.T @ z, 44, k))
    for emb, want in ((alg.embed_netmf(g, 4, 2), svd(net, 4)), (alg.embed_grarep(g, 4, 2), np.hstack([svd(a, 2) for a in logs]))):
        at, v = la.to_local(emb)
        assert at == ids and np.allclose(v, la.local_l2(want), atol=1e-6)
    assert la.to_local(alg.embed_hope(g, 8))[1].shape == (44, 8)


def test_metapath_steps_move_lists(spark, monkeypatch):
    """Ends by pairs as a plain join has them: ids of several types, long lists, repeats, a missing id, a self-pair."""
    from hypergraph_spark.operators import hetero

    monkeypatch.setattr(hetero, "LIST_ENDS", 8)
    rng = np.random.default_rng(3)
    ab = [(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))] + [(7, None), (None, 3)]
    bc = [(int(b), int(c)) for b, c in rng.integers(0, 60, (300, 2))] + [(5, c) for c in range(60)] + [(3, None), (None, 2**40)]
    ca = [(int(c), int(a)) for c, a in rng.integers(0, 60, (300, 2))]
    name = lambda t, x: t if x is None else f"{t}_{x}"
    step = lambda pairs, nxt: {(s, e) for s, d in pairs for m, e in nxt if d == m}
    p = {(name("a", s), name("b", d)) for s, d in ab}
    p = step(p, {(name("b", s), name("c", d)) for s, d in bc})
    q = {x for x in step(p, {(name("c", s), name("a", d)) for s, d in ca}) if x[0] != x[1]}
    for mid in ("bigint", "int", "string"):
        g = hetero.HeteroGraph().add_edge_type("ab", "a", "b", spark.createDataFrame(ab, "src bigint, dst bigint"))
        g.add_edge_type("bc", "b", "c", spark.createDataFrame(bc, "src bigint, dst bigint").selectExpr(f"cast(src as {mid}) src", "dst"))
        g.add_edge_type("ca", "c", "a", spark.createDataFrame(ca, "src bigint, dst bigint"))
        for path, want in ((["ab", "bc"], p), (["ab", "bc", "ca"], q)):
            got = [tuple(r) for r in g.metapath_pairs(path).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    plan = g.metapath_pairs(["ab", "bc"])._jdf.queryExecution().executedPlan().toString()
    assert "ends" in plan  # lists go through the exchange, not pairs


def test_pairs_are_mirrored_after_sums_and_weights(spark):
    """Joins and sums see a pair once; the other direction is made last. Names on both sides, loops and missing tokens count as before."""
    from hypergraph_spark.plans.graph import legacy_relations

    g = graph_from_lines(lines(spark, "a b", "a c c", "a b c", "d"), NODE)
    plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Generate") < plan.index("Join")  # the outermost step first
    sums = {r[0]: r[1] for r in g.degrees().collect()}
    for r in g.edges.collect():
        assert r["left_w"] == pytest.approx(r["value"] / sums[r["src"]]) and r["sym_w"] == pytest.approx(r["value"] / (sums[r["src"]] * sums[r["dst"]]) ** 0.5)
    data = [[["p", "q"], ["b__x", "p"], ["x", "y"]], [["q"], ["b__x"], ["x", "p", "x"]], [["p", None], ["p"], ["y"]]]
    cells = spark.createDataFrame([(c,) for c in data], "cells array<array<string>>")
    spec = "complex::reflexive::r complex::a complex::a__b"
    for salted in (True, False):
        want: dict = {}
        names = ["r", "a", "a__b"]
        for i, j in ((0, 1), (0, 2), (1, 2), (0, 0)):
            for c in data:
                total = len(c[0]) ** 2 * len(c[1]) * len(c[2])
                for x in c[i]:
                    for y in c[j]:
                        x_, y_ = [t if t is None or not salted else f"{names[k]}__{t}" for k, t in ((i, x), (j, y))]
                        for s, d in ((x_, y_), (y_, x_)):
                            if s is not None:
                                v = want.setdefault((f"{names[i]}__{names[j]}", s, d), [0.0, 0.0])
                                v[0] += 1 / (len(c[i]) * len(c[j]))
                                v[1] += total / (len(c[i]) * len(c[j]))
        got = {(r["relation"], r["src"], r["dst"]): r for r in legacy_relations(cells, spec, salted).collect()}
        assert set(got) == set(want)
        for (n, s, d), (v, _) in want.items():
            own = [w for (m, a, _), w in want.items() if (m, a) == (n, s)]
            r = got[n, s, d]
            assert r["value"] == pytest.approx(v) and r["weight"] == pytest.approx(v / sum(w[0] for w in own)) and r["occurrence"] == round(sum(w[1] for w in own))
    plan = legacy_relations(cells, "r a__b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_embed_brings_neither_first_nor_last_vectors_to_the_driver(spark, monkeypatch):
    g = graph_from_lines(lines(spark, "a b", "b c d", "d e", "a e f", "f g", "z"), NODE).cache()
    rounds = []
    dot = la.SparseOperator.dot
    monkeypatch.setattr(la.SparseOperator, "dot", lambda self, x: rounds.append(1) or dot(self, x))
    for white in (False, True):
        want = la.to_local(em.embed(g, 3, 3, whiten=white, callback=lambda i, m: None))
        assert len(rounds) == 3
        rounds.clear()
        with monkeypatch.context() as m:
            m.setattr(la, "to_local", None)
            m.setattr(la, "to_emb", None)
            out = em.embed(g, 3, 3, whiten=white)
        got = la.to_local(out)
        assert len(rounds) == 2 and got[0] == want[0] and np.allclose(got[1], want[1], atol=1e-9)
        rounds.clear()
    loose = la.to_local(em.embed(g, 3, 1, edges=g.edges.where("src <> 'z'"), whiten=False))
    assert loose[0][-1] == "z" and not loose[1][-1].any()
    assert em.embed(g, 3, 0).count() == 8
