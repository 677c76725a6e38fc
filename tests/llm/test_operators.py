"""Corpus operators against brute force and on the hard rows: nulls, empties, repeats, ties, clashing columns, no rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from hypergraph_spark.llm import decontaminate as dc
from hypergraph_spark.llm import fingerprints as fpr
from hypergraph_spark.llm import html as ht
from hypergraph_spark.llm import queries as llm_queries
from hypergraph_spark.llm import suffix as sx
from hypergraph_spark.llm.components import connected_components
from hypergraph_spark.llm.lines import dedup_lines
from hypergraph_spark.llm.mixing import curriculum_mix, source_targets
from hypergraph_spark.llm.sharding import jump_hash, shard_documents
from hypergraph_spark.llm.simhash import drop_near_duplicates, simhash, simhash_components
from hypergraph_spark.llm.toxicity import LexiconAutomaton, fit_toxicity, score_rows, score_toxicity
from hypergraph_spark.llm.urls import Rule, filter_urls, parse_rule, sweep
from hypergraph_spark.llm.vptree import build_tree, link_fingerprints

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size long, shard string, slot string, grown_shard string, fp string, row string, n string, key string, line string, copies string, taken string, target string, positions string, spans string, kept string, n_bytes string, n_lines string, n_dropped string, source_size string, id string, tag string, part string, score string, features string, y string, item_id string, shared string, g string, pos string, root string, node string, __id string, __th string, __h string, __row string, __a string, __b string, __s string, __n string, __key string, __tie string, __bucket string, __offset string, __order string, __mid string, __position string, __lost string, __lines string, __null string, __keep string, __pos string, __spans string, __text string, __in_1 string, `a.b` string, held_out string"


def docs(spark, rows, clash=False):
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    if clash:
        k = CLASH.count(",")
        full = [(*r, 7, *["x"] * (k - 1)) for r in full]
    return spark.createDataFrame(full, SCHEMA + (CLASH if clash else ""))


def word_salad(seed, n, vocab=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


HARD = [(None, "alone here", "a"), (1, None, "a"), (2, "", None), (3, "", "b"), (4, "one", "b"), (4, "one", "b"), (5, "same id, other text", "b"), (5, "one", "c"), (6, "é" * 300, "c"), (7, "\n\n \t", "c"), (8, word_salad(0, 30_000), "a")]


@pytest.fixture(params=["hard", "clash", "empty"])
def table(spark, request):
    return docs(spark, [] if request.param == "empty" else HARD, request.param != "hard"), 0 if request.param == "empty" else len(HARD)


def test_no_operator_drops_or_breaks_on_hard_rows(spark, table):
    df, n = table
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 0, 1), (8, 1, None)] if n else [], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "alone here")] if n else [], "item_id long, text string")
    assert len(simhash_components(df).collect()) == n
    assert len(fpr.version_fingerprints(df).collect()) == n
    shards = shard_documents(df, grown=9).collect()
    assert len(shards) == n
    for s in range(8):
        own = sorted(r["slot"] for r in shards if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in shards)
    assert len(score_toxicity(df, labels).collect()) == n
    assert len(sx.drop_repeats(df).collect()) == n
    assert len(dedup_lines(df, 1, 2).collect()) == n
    mixed = curriculum_mix(df).collect()
    assert len(mixed) == n and all(r["taken"] <= 2 * r["size"] for r in mixed)
    hits = {(r["doc_id"], r["item_id"]) for r in dc.find_contaminated(df, bench).collect()}
    assert hits == ({(4, 1), (5, 1), (None, None)} if n else set())
    assert len(dc.decontaminate(df, bench).collect()) == max(0, n - 4)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    if "__id" in df.columns:  # other columns come back as they were, whatever their names
        for out in (shard_documents(df), sx.drop_repeats(df), dedup_lines(df, 1, 2), curriculum_mix(df), dc.decontaminate(df, bench), kept):
            assert all(r["__id"] == r["__th"] == r["__row"] == r["__key"] == r["__in_1"] == r["a.b"] == "x" for r in out.collect())
    # Texts: alone here, '' (of null, two empties and the blank one), one, same id.., é.., the long one.
    assert len(kept.collect()) == (6 if n else 0)


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    for name, rows, schema in (("labels", [(4, 0, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, word_salad(3, 20))], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    for rows, clash in ((HARD, True), (HARD, False), ([], True)):
        df = docs(spark, rows, clash)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, d)
            assert df.columns == docs(spark, [], clash).columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, d).count() >= 0


def test_pipeline_decisions(spark, tmp_path):
    """Toxic, copied and leaked documents go, clean ones stay, and what stays is mixed and sharded."""
    import corpus_pipeline

    d = str(tmp_path)
    item = word_salad("item", 40)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        text = word_salad(i, 60) + (" vilewort and vilewort" if toxic else "")
        rows.append((i, text, f"s{i % 4}"))
        labels.append((i, 0, int(toxic)))
    copy = rows[1][1]
    near = copy.split()
    near[30] = "changed"
    rows += [(1000, copy, "s0"), (1001, " ".join(near), "s1"), (1002, word_salad(5000, 50) + " " + item + " " + word_salad(5001, 50), "s2"), (1003, word_salad(5002, 40) + " vilewrt", "s0")]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = [r.asDict() for r in corpus_pipeline.run(spark, d).collect()]
    ids = {r["doc_id"] for r in out}
    clean = {i for i in range(400) if i % 8}
    assert ids <= clean and not ids & {1000, 1001, 1002, 1003}
    by = defaultdict(Counter)
    for r in out:
        by[r["source"]][r["doc_id"]] += 1
    # The mix takes 1.5 times all words, so by weight some sources lose documents and others repeat.
    assert max(by["s0"].values()) == 2 and len(ids) > 0.6 * len(clean)
    for s in range(8):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))


# --- SimHash ------------------------------------------------------------------------------------------------------


def test_simhash_components_against_all_pairs(spark):
    rows = [(i, word_salad(i, 40), "a") for i in range(120)]
    rows += [(200 + i, rows[i][1], "a") for i in range(10)]
    for i in range(60):
        w = rows[i][1].split()
        w[i % 40] = "changed"
        rows.append((300 + i, " ".join(w), "b"))
    rows += [(400, "", "b"), (401, None, "b"), (402, "Two Words", "b"), (403, "two words", "b")]
    want = {i: simhash((t or "").encode()) for i, t, _ in rows}

    def slow(t):
        w = t.lower().split()
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert all(slow(t or "") == want[i] for i, t, _ in rows)
    root = {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(want)
    for a in ids:
        for b in ids:
            if a < b and (want[a] ^ want[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in simhash_components(docs(spark, rows)).collect()}
    assert {i: got[i]["fp"] % 2**64 for i in ids} == want
    assert {i: got[i]["component_id"] for i in ids} == {i: find(i) for i in ids}


@pytest.mark.parametrize("mask", [2**64 - 1, 2**32 - 1])
def test_vantage_point_tree_meets_every_pair(mask):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    tree = build_tree(points, len(points), mask, 2, 16)
    assert tree.leaves > 4
    leaves = defaultdict(set)
    for i, leaf in zip(*tree.visit(points), strict=True):
        leaves[int(i)].add(int(leaf))
    for i in range(len(points)):
        d = np.bitwise_count((points ^ points[i]) & np.uint64(mask))
        assert all(leaves[i] & leaves[int(j)] for j in np.flatnonzero(d <= 2))


def test_links_in_small_blocks(spark):
    """A dense cluster dealt out in many blocks still connects wholly."""
    fps = spark.createDataFrame([(int(x),) for x in range(256)] + [(7 * 2**40 + 5,)], "fp long")
    got = connected_components(link_fingerprints(fps, 1, leaf_rows=8, block_rows=16))
    assert {r["node"] for r in got.collect()} == set(range(256))
    assert {r["root"] for r in got.collect()} == {0}


def test_copies_per_row_stay_bounded(spark):
    """Leaves stay of one size as rows grow, so a row goes to some more leaves only: 1.2 times as many at double the rows."""
    from pyspark.sql import functions as F

    from hypergraph_spark.llm.vptree import HALVES, fit_trees

    points = np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)
    copies = []
    for n in (10_000, 100_000, 1_000_000):
        trees = fit_trees(spark.range(n).select(F.xxhash64("id").alias("fp")), n, HALVES, 1, 512, 2048)
        own = np.bincount(trees[0].home(points), minlength=trees[0].leaves)
        assert own.max() < 8 * 512 * len(points) / n + 30
        copies.append(sum(len(t.visit(points)[0]) for t in trees) / len(points))
    assert copies[2] < 2.5 * copies[1] < 6.5 * copies[0]


def test_grafted_trees_meet_every_pair(spark):
    from hypergraph_spark.llm.vptree import HALVES, fit_trees

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 63, 3000).astype(np.uint64)), np.arange(500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    trees = fit_trees(df, len(points), HALVES, 1, 32, 64)
    assert all(t.leaves > 64 // 16 for t in trees)
    for t in trees:
        assert (np.sort(np.unique(t.home(points))) < t.leaves).all()
        leaves = defaultdict(set)
        for i, leaf in zip(*t.visit(points), strict=True):
            leaves[int(i)].add(int(leaf))
        assert all(int(h) in leaves[i] for i, h in enumerate(t.home(points)))
        for i in range(0, len(points), 7):
            d = np.bitwise_count((points ^ points[i]) & np.uint64(t.mask))
            assert all(leaves[i] & leaves[int(j)] for j in np.flatnonzero(d <= 1))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_duplicates_against_exact_similarity(spark):
    rows, n = [], 0
    for i in range(60):
        w = word_salad(i, 50 + 7 * i, 5000).split()
        rows.append((n, " ".join(w), "a"))
        n += 1
        v = list(w)
        v[len(v) // 2] = "swap"
        rows.append((n, " ".join(v), "a"))
        n += 1
        half = w[: len(w) // 2] + word_salad(1000 + i, len(w) // 2, 5000).split()
        rows.append((n, " ".join(half), "a"))
        n += 1
    kept = {r["doc_id"] for r in drop_near_duplicates(docs(spark, rows)).collect()}
    assert kept == {i for i in range(n) if i % 3 != 1}


# --- fingerprints -------------------------------------------------------------------------------------------------


def test_peeling_recovers_differences():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(20)]
    others = [np.concatenate([s[5:], rng.integers(0, 2**63, i, dtype=np.uint64)]) for i, s in enumerate(sets)]
    a, b = fpr.sketch(sets, 96), fpr.sketch(others, 96)
    solved, owner, digest, side = fpr.peel(fpr.subtract(a, b))
    assert solved.all()
    for i, (x, y) in enumerate(zip(sets, others, strict=True)):
        assert set(digest[(owner == i) & (side > 0)].tolist()) == set(np.setdiff1d(x, y).tolist())
        assert set(digest[(owner == i) & (side < 0)].tolist()) == set(np.setdiff1d(y, x).tolist())
    small = [fpr.sketch(x, 6) for x in (sets, others)]
    assert not fpr.peel(fpr.subtract(*small))[0].all()
    lost, new = fpr.differences(sets, others, *small)
    assert lost.tolist() == [len(np.setdiff1d(x, y)) for x, y in zip(sets, others, strict=True)]
    assert new.tolist() == [len(np.setdiff1d(y, x)) for x, y in zip(sets, others, strict=True)]
    like = fpr.likeness(sets, others, lost + new)
    assert like[3] == pytest.approx(1 - (5 + 3) / (50 + 48))
    none = [np.empty(0, np.uint64)]
    assert fpr.likeness(none, none, np.zeros(1)).tolist() == [1.0]
    # A digest twice in one set never peels; retries end all the same.
    twice = [np.array([5, 5, 9], np.uint64)]
    assert [x.tolist() for x in fpr.differences(twice, none, fpr.sketch(twice, 15), fpr.sketch(none, 15))] == [[2], [0]]


def test_version_fingerprints_in_order(spark):
    rows = [(i * 3 % 101, word_salad(i, i % 50) + "\n" + word_salad(i, 5), "a") for i in range(101)] + [(500, None, "a"), (501, "x", "a"), (502, "x", "a")]
    got = {r["doc_id"]: r for r in fpr.version_fingerprints(docs(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
        mine, new, after = (set(fpr.paragraph_digests(x.encode()).tolist()) for x in (t, edited, nxt))
        for near, other in (("near_edited", new), ("near_next", after)):
            assert got[i][near] == pytest.approx(1 - len(mine ^ other) / (len(mine) + len(other)) if mine or other else 1.0)
        assert (got[i]["lost_edited"], got[i]["new_edited"]) == (len(mine - new), len(new - mine))
        assert got[i]["fingerprint"] == fpr.sketch([np.array(sorted(mine), np.uint64)], 15)[0].tobytes().hex()
    assert got[501]["fingerprint"] == got[502]["fingerprint"] and got[501]["near_next"] == 1.0


# --- sharding, lines, mixing --------------------------------------------------------------------------------------


def test_jump_hash_moves_only_into_new_shards():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64)
    before = jump_hash(keys, 8)
    after = jump_hash(keys, 9)
    assert set(after[after != before]) == {8}
    assert abs((after != before).mean() - 1 / 9) < 0.01
    assert np.abs(np.bincount(before) / 2500 - 1).max() < 0.1


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    common = [f"  Shared Line Number {i} \t" for i in range(4)]
    rows = []
    for i in range(40):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own line of document {i} {j} xxxxxxxx" for j in range(6)]
        lines += ["short", "short"]
        rows.append((i, "\n".join(lines), "a"))
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    where = defaultdict(set)
    for i, t, _ in rows:
        for x in t.split("\n"):
            where[key(x)].add(i)
    got = {r["doc_id"]: r for r in dedup_lines(docs(spark, rows), 20, 3).collect()}
    for i, t, _ in rows:
        keep = [x for x in t.split("\n") if len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == i]
        assert got[i]["text"] == "\n".join(keep)
        assert got[i]["n_dropped"] == len(t.split("\n")) - len(keep)


def test_many_shared_lines_are_linear(spark):
    import time

    text = "\n".join(f"a shared line with number {i}" for i in range(16_000))
    began = time.time()
    got = {r["doc_id"]: r for r in dedup_lines(docs(spark, [(i, text + f"\nown {i}", "a") for i in range(3)])).collect()}
    assert time.time() - began < 20
    assert [got[i]["text"] for i in range(3)] == ["own 0", "own 1", text + "\nown 2"] and got[0]["n_dropped"] == 16_000


def test_lines_of_rows_that_share_an_id(spark):
    shared = "this line is long enough to count"
    rows = [(1, f"first\n{shared}", "a"), (1, f"{shared}\nsecond", "a"), (2, f"{shared}\n{shared}", "a"), (3, shared, "a"), (1, None, "b"), (4, f"\n{shared}x\n", "a")]
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs(spark, [x for x in rows if x[1] is not None])).collect())
    assert got == [(1, "first", 2, 1), (1, "second", 2, 1), (2, "", 2, 2), (3, shared, 1, 0), (4, f"\n{shared}x\n", 3, 0)]
    assert [r["text"] for r in dedup_lines(docs(spark, rows)).where("source = 'b'").collect()] == [None]


def test_training_rows_are_in_order_of_position(spark):
    from hypergraph_spark.llm.mixing import CURRICULUM, training_rows

    rows = [(i, word_salad(i, 5 + i % 20), "abc"[i % 3]) for i in range(120)]
    df = docs(spark, rows, clash=True)
    mixed = {r["doc_id"]: r for r in curriculum_mix(df, schedules=CURRICULUM).collect()}
    out = training_rows(df, schedules=CURRICULUM)
    assert out.columns == df.columns
    got = out.collect()
    want = sorted((p, i) for i, r in mixed.items() for p in r["positions"])
    assert [r["doc_id"] for r in got] == [i for _, i in want] and {r["taken"] for r in got} == {"x"}
    early = Counter(r["source"] for r in got[: len(got) // 4])
    assert early["a"] > early["c"]


def test_targets_fill_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            open_.remove(s)
            left -= target[s]
    target |= {s: share * weight[s] for s in open_}
    assert got == pytest.approx(target)


def test_mix_reaches_targets_and_follows_schedules(spark):
    rows = [(i, word_salad(i, 5 + i % 20), "ab"[i % 2]) for i in range(400)]
    ramp = {"a": [(0.0, 0.0), (1.0, 1.0)], "b": [(0.0, 1.0), (0.5, 1.0), (1.0, 0.0)]}
    out = curriculum_mix(docs(spark, rows), schedules=ramp).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        at = sorted((p, r["size"]) for r in own for p in r["positions"])
        early = sum(z for p, z in at if p < 0.5) / sum(z for _, z in at)
        assert early == pytest.approx(0.25 if s == "a" else 2 / 3, abs=0.03)
    firsts = [r["positions"][0] if r["positions"] else 2.0 for r in out]
    assert firsts == sorted(firsts)
    again = curriculum_mix(docs(spark, rows).repartition(7), schedules=ramp).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in out}


def test_mix_does_not_depend_on_buckets(spark):
    df = docs(spark, [(i, word_salad(i, 1 + i % 9), "abc"[i % 3 % 2]) for i in range(300)] + HARD)
    want = sorted(map(repr, curriculum_mix(df).collect()))
    for buckets, bucket_rows in ((1, 50_000), (3, 20), (256, 1)):
        assert sorted(map(repr, curriculum_mix(df, buckets=buckets, bucket_rows=bucket_rows).collect())) == want


# --- toxicity -----------------------------------------------------------------------------------------------------


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8)))
    lexicon = sorted({word() for _ in range(12)})
    a = LexiconAutomaton(lexicon, 1, 5)
    for _ in range(3000):
        w = word()
        best = min((d for e in lexicon if (d := edits(w, e)) == 0 or d == 1 and len(e) >= 5), default=None)
        got = a.match(w)
        assert (got[0] if got else None) == best, w
    stem = LexiconAutomaton(["lowei*"], 1, 5)
    assert stem.match("loweixyz") == (0, 0) and stem.match("lowexyz")[0] == 1 and stem.match("other") is None


def test_toxicity_learns_terms_misspellings_and_quotes(spark):
    rows, labels = [], []
    for i in range(300):
        kind = i % 6
        text = word_salad(i, 40)
        if kind == 0:
            text += " you dreadfool"
        elif kind == 1:
            text += ' he wrote "dreadfool" in the report'
        rows.append((i, text, "a"))
        labels.append((i, 0, int(kind == 0)))
    df = docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(df, lab).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = np.mean([got[i]["predicted"] == int(i % 6 == 0) for i in got if got[i]["held_out"]])
    assert right > 0.95
    model = fit_toxicity(df, lab)
    extra = docs(spark, [(1, word_salad(900, 30) + " you dreadfol", "a"), (2, word_salad(901, 30), "a")])
    score = {r["doc_id"]: r["score"] for r in score_rows(extra, model).collect()}
    assert score[1] >= 0.5 > score[2]


def test_scores_against_plain_features(spark):
    """A document's score from edit distances to every entry, word by word."""
    rows, labels = [], []
    for i in range(240):
        text = word_salad(i, 30) + (f" you {['dreadfool', 'stinkhead'][i % 2]}" if i % 5 == 0 else "")
        rows.append((i, text, "a"))
        labels.append((i, 0, int(i % 5 == 0)))
    rows += [(900, "a dreadfol and a stinkheads", "a"), (901, 'they said "dreadfool" today', "a"), (902, None, "a"), (903, "DREADFOOL", "a")]
    df = docs(spark, rows)
    model = fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.entries

    def nearest(w):
        found = []
        for i, e in enumerate(model.entries):
            stem = e.rstrip("*")
            ends = range(len(w) + 1) if e.endswith("*") else [len(w)]
            d = min(edits(w[:k], stem) for k in ends)
            if d == 0 or d == 1 and len(stem) >= 5:
                found.append((d, i))
        return min(found, default=None)

    import re

    got = {r["doc_id"]: r["score"] for r in score_rows(df, model).collect()}
    for i, text, _ in rows[::7] + rows[-4:]:
        low = (text or "").lower()
        abuse, quote, bad = [], [], 0
        for m in re.finditer(r"[^\W\d_]+", low):
            if hit := nearest(m.group()):
                w = float((model.near if hit[0] else model.exact)[hit[1]])
                bad += hit[0] > 0
                left, right = low[max(0, m.start() - model.window) : m.start()], low[m.end() : m.end() + model.window]
                cited = '"' in left and '"' in right or re.search(r"\bsaid\b", left)
                (quote if cited else abuse).append(w)
        x = [max([0.0, *abuse]), np.log1p(sum(max(w, 0) for w in abuse)), np.log1p(len(abuse)), max([0.0, *quote]), np.log1p(len(quote)), np.log1p(bad)]
        want = 1 / (1 + np.exp(-(model.weights[0] + np.dot(x, model.weights[1:]))))
        assert got[i] == pytest.approx(want), i


def test_a_repeated_id_does_not_multiply_the_sample(spark):
    from hypergraph_spark.llm import toxicity

    df = docs(spark, [(1, "vile wordery", "a")] * 50 + [(2, "fine words", "a")])
    seen, keep = [], toxicity.materialize
    toxicity.materialize = lambda d, tag: seen.append(out := keep(d, tag)) or out
    try:
        fit_toxicity(df, spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    finally:
        toxicity.materialize = keep
    assert seen[0].count() == 2


# --- suffixes -----------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


def test_repeats_against_brute_force(spark):
    passage = word_salad("p", 60)
    rows = []
    for i in range(30):
        t = word_salad(i, 60)
        if i % 3 == 0:
            t = t[: 50 + i] + passage[i : 200 + 3 * i] + t[90:]
        rows.append((i, t, "a"))
    rows += [(100, rows[4][1], "a"), (101, "ab" * 300, "a"), (102, "z" * 350 + "y" * 260, "a"), (103, None, "a"), (104, "ü" * 150, "a"), (105, rows[5][1][:250], "a"), (106, "short", "a")]
    df = docs(spark, rows)
    for length in (200, 90):
        cover = brute_repeats([(t or "").encode() for _, t, _ in rows], length)
        got = {r["doc_id"]: r for r in sx.drop_repeats(df, length).collect()}
        for (i, t, _), c in zip(rows, cover, strict=True):
            raw = (t or "").encode()
            kept = bytes(b for b, gone in zip(raw, c, strict=True) if not gone)
            assert bytes(got[i]["kept"]) == kept, (length, i)
            assert got[i]["n_removed"] == int(c.sum())
            assert got[i]["n_spans"] == int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum())


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(4)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(rng.randrange(30))) for _ in range(7)]

    def coded(run):
        before = b""
        for x in run:
            yield sx.common_prefix(before, x, 0), x, None
            before = x

    out = list(sx.LoserTree([coded(r) for r in runs]))
    assert [x[1] for x in out] == sorted(x for r in runs for x in r)
    before = b""
    for n, x, _ in out:
        assert n == sx.common_prefix(before, x, 0)
        before = x
    entries = sorted((bytes(rng.choices(b"ab", k=9)), b"left", 1, 2, i) for i in range(20))
    back = list(sx._decode([sx._encode(entries[:11]), sx._encode(entries[11:], entries[10][0])]))
    assert [(k, p) for _, k, p in back] == [(e[0], (1, 2, e[4], b"left")) for e in entries]
    assert [n for n, _, _ in back] == [0] + [sx.common_prefix(a[0], b[0], 0) for a, b in zip(entries, entries[1:], strict=False)]


def test_a_very_common_anchor_fits_in_memory():
    """Many entries of one anchor with contexts of their own: bounded bytes an entry, seconds, and the right pairs."""
    import time
    import tracemalloc

    rng = np.random.default_rng(2)
    n, reach = 60_000, 200 - sx.GRAM
    after = np.sort(rng.integers(0, 2**63, n - 2, dtype=np.uint64))
    gram = b"g" * (8 + sx.GRAM)
    tracemalloc.start()
    began, entries, before = time.time(), sx._Entries(reach), b""
    for i, x in enumerate([0, 0, *after.tolist()]):  # the first two are alike
        key = gram + x.to_bytes(8, "big") + b"k" * (reach - 8)
        left = (b"same" if i < 2 else b"%08d" % i) + b"l" * (reach - 8)
        entries.add(sx.common_prefix(before, key, 0), key, (i, 7, 1000, left))
        before = key
    got = sx._resolve(entries, 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:, 0].tolist()[:2] == [0, 1] and set(map(tuple, got[:2, 2:].tolist())) == {(1000 - 4 - (reach - 8), 1200)}
    assert most < 1000 * n and time.time() - began < 60


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    pos, _ = sx.anchors(data, 100)
    for s in range(len(data) - 99):
        assert ((pos >= s) & (pos + sx.GRAM <= s + 100)).any()
    assert sx.anchors(data[:99], 100)[0].tolist() == []


# --- urls, benchmark, html ----------------------------------------------------------------------------------------


def test_sweep_against_every_rule(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "a.example.com", "ample.com", "b.org", "org", "x.b.org"]
    rules = list({Rule(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(["/", "/en/", "/en/7", "/d", ""])) for _ in range(14)})
    seen, unique = set(), []
    for r in rules:
        if (r.host, r.path) not in seen:
            seen.add((r.host, r.path))
            unique.append(r)
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7?x=/d#y", "http://a.example.com#/en/"] + [f"https://{rng.choice(hosts + ['z.a.example.com', 'other.net', 'xexample.com'])}{rng.choice(['', '/', '/en/', '/en/70?q', '/d#e', '?a/b'])}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' host", "'x' rule", "'x' __key", "'y' __row", "'z' __rule")
    for r in filter_urls(df, unique).collect():
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail.split("?")[0].split("#")[0] if tail.startswith("/") else ""
        assert (r["host"], r["path"]) == (host, path)
        fits = [x for x in unique if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.host) + len(x.path), len(x.host)), default=None)
        assert (r["__key"], r["__row"], r["__rule"]) == ("x", "y", "z")
        assert (r["rule"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "allow"))
    assert sweep([parse_rule("block", "com/en/")], [], []) == []
    assert filter_urls(df.limit(0), unique).count() == 0 and filter_urls(df, []).where("verdict != 'allow'").count() == 0


def test_url_rules_are_the_contract_s(spark, tmp_path):
    urls = {"http://x.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.example.net/de/80": ("example.net/de/8", "block"), "http://b.com/en/7": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://c.org/es/": ("org/es/", "block"), "http://c.org/e": (None, "allow")}
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = llm_queries.op6_url_filters(spark, str(tmp_path)).collect()
    assert [(r["rule"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])] == list(urls.values())
    assert [(r.verdict, r.name) for r in llm_queries.RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert all(f"('{r.verdict}', '{r.host}', '{r.path}')" in llm_queries.ORACLE_SQL["op6_url_filters"] for r in llm_queries.RULES)


def test_containment_against_exact_search(spark):
    items = [(i, word_salad(f"i{i}", n)) for i, n in enumerate([3, 5, 8, 20, 60, 200])]
    rows = []
    for i in range(60):
        t = word_salad(i, 300)
        if i % 2:
            item = items[i // 2 % len(items)][1].split()
            for _ in range(i // 20 * max(1, len(item) // 30)):
                item[random.Random(i).randrange(len(item))] = "hole"
            w = t.split()
            t = " ".join(w[:150] + item + w[150:])
        rows.append((i, t.upper(), "a"))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))}

    want = set()
    for i, t, _ in rows:
        w = t.lower().split()
        for k, x in items:
            s = shingles(x)
            n = len(next(iter(s)))
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if len(s & have) >= 0.8 * len(s):
                want.add((i, k))
    got = dc.find_contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div id="cookie-notice">We use cookies</div><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<article><h1>Head &amp; Title</h1><p>One <b>bold</b>
 text.<br>Next<p>Two&nbsp;&lt;x&gt;<div class="ad">Buy!</div><form><input>Mail</form><section class="comments"><p>First!</p></section><ul><li>i<li>j</ul></article>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_main_text():
    assert ht.main_text(PAGE) == "Head & Title\nOne bold text.\nNext\nTwo <x>\ni\nj"
    assert ht.main_text("") == "" and ht.main_text("<p>unclosed <b>bold") == "unclosed bold"
    assert ht.main_text("a < b <!-- c --> d") == "a < b d"
    assert ht.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert ht.main_text('<article><div class="article-header"><h1>Title</h1></div><p>x</p></article>') == "Title\nx"
    assert ht.main_text("<main><p>intro</p><article><p>x</p></article></main>") == "intro\nx"
    assert ht.main_text('<article><p class="meta">m</p><table class="side"><tr><td>a<td>b</table></article>') == "m\na\nb"
    assert ht.main_text("<p title='a>b'>q</p><p>x <a href=\"foo>y</a> z<p>w") == "q\nx y z\nw"
    # A part's name is a prior only: it does not take most of the page's text away.
    assert ht.main_text("<div class='related'><p>The whole long text of this page</p></div><p>end</p>") == "The whole long text of this page\nend"


@pytest.mark.parametrize("part", ['<a b="', "<div>a", "<b><li>", "</zzz>", "<p><svg>", "<a b='\"'", "< ", "<i>", "<td><i>"])
def test_pages_parse_in_linear_time(part):
    import time

    took = []
    for n in (100_000, 400_000):
        began = time.time()
        ht.main_text(part * (n // len(part)))
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def labelled_site(rng, pages):
    """(html, main text) of pages of one template: strips, related lists and bars without telling names, texts of their own."""
    strips = [word_salad(f"strip{i}", 12) for i in range(3)]
    out = []
    for i in range(pages):
        paragraphs = [word_salad(f"{i} {j} {rng.random()}", rng.randrange(15, 60), 5000) for j in range(rng.randrange(1, 7))]
        title = word_salad(f"title{i}", 6, 5000)
        links = "".join(f"<li><a href='/{k}'>section {k}</a></li>" for k in range(8))
        body = f"<div class='x1'><ul>{links}</ul></div><div class='x2'><div class='hd'><h1>{title}</h1></div>"
        body += "".join(f"<p>{p}</p>" + (f"<div class='x3'><p>{strips[0]}</p></div>" if j == 0 else "") for j, p in enumerate(paragraphs))
        body += f"</div><div class='x4'><p>{strips[1]}</p><p>{strips[2]}</p></div>"
        out.append((f"<html><body>{body}</body></html>" if i % 2 else f"<html><body>{body.replace('x2', 'x2 wide')}</body></html>", "\n".join([title, *paragraphs])))
    return out


def test_style_trees_against_labelled_pages(spark):
    rng = random.Random(5)
    made = labelled_site(rng, 60)
    marked = [(h.replace("<body>", "<body><article>").replace("</body>", "</article></body>"), t) for h, t in labelled_site(rng, 60)]
    rows = [(i, "http://plain.example/a", h) for i, (h, _) in enumerate(made)] + [(100 + i, "http://marked.example/a", h) for i, (h, _) in enumerate(marked)]
    want = {i: t for i, (_, t) in enumerate(made)} | {100 + i: t for i, (_, t) in enumerate(marked)}
    got = {r["page_id"]: r["text"] for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hit = sum(sum((Counter(got[i].split()) & Counter(want[i].split())).values()) for i in want)
    assert hit / sum(len(got[i].split()) for i in want) > 0.98, "precision"
    assert hit / sum(len(t.split()) for t in want.values()) > 0.98, "recall"


def slow_tree(pages, enough=8, decay=0.9):
    """Importance by (path) of one host's pages, by recursion over a dict of nodes."""
    import math

    nodes = defaultdict(lambda: {"styles": Counter(), "blocks": Counter(), "mass": 0})
    for page in pages:
        blocks, styles = ht.read_page(page)
        blocks = ht.candidates(blocks)
        for path, text in {(b.path, b.text) for b in blocks}:
            nodes[path]["blocks"][text] += 1
        for b in blocks:
            nodes[b.path]["mass"] += len(b.text)
        for path in {tuple(b.path.split("/")[:k]) for b in blocks for k in range(1, b.path.count("/") + 2)}:
            nodes["/".join(path)]["styles"][tuple(sorted(set(styles.get(path, ()))))] += 1

    def weigh(path):
        x = nodes[path]
        m = sum(x["styles"].values())
        base = math.log(max(m, enough))
        n = sum(x["blocks"].values())
        own = 1 - min(1, sum(k * math.log(k) for k in x["blocks"].values()) / n / base) if n else 0
        shown = sum(-k / m * math.log(k / m) for k in x["styles"].values()) / base
        stay = decay ** (len(x["styles"]) - 1)
        below = [weigh(c) for c in list(nodes) if c.rpartition("/")[0] == path]
        mass = x["mass"] + sum(w[0] for w in below)
        value = (1 - stay) * shown * mass + stay * (x["mass"] * own + sum(w[0] * w[1] for w in below))
        out[path] = value / max(mass, 1)
        return mass, out[path]

    out = {}
    weigh("#")
    return out


def test_style_tree_against_recursion(spark):
    pages = [h for h, _ in labelled_site(random.Random(6), 20)]
    df = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["path"]: r["importance"] for r in ht.style_tree(ht.read_pages(df, ["page_id"], "html", "url")).collect()}
    assert got == pytest.approx(slow_tree(pages)) and len(got) > 10


def test_style_trees_drop_repeated_branches(spark):
    rows = [(i, "http://h.example/x", f"<body><div><p>Own words of page {i}</p></div><div class='strip'><p>Always the same strip</p></div></body>") for i in range(8)]
    rows += [(100, None, None), (101, "http://one.example/", "<body><div class='strip'><p>Always the same strip</p></div></body>"), (100, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "'x' host", "'x' __host", "'x' __page", "'x' __low", "'x' __of", "'x' __blocks")
    got = defaultdict(list)
    for r in ht.extract_text(df).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
        assert r["__host"] == r["__page"] == r["__low"] == r["__of"] == r["__blocks"] == "x"
    assert got[3] == [("Own words of page 3", 19)] and got[100] == [("", 0)] * 2 and got[101] == [("Always the same strip", 21)]
    assert ht.extract_text(df.limit(0)).count() == 0


def test_digests_have_independent_halves(spark):
    """A chained second hash is the same function of the first for every text; a seeded one is not."""
    from pyspark.sql import functions as F

    from hypergraph_spark.llm.lines import _digest

    rows = spark.range(64).select(_digest(F.col("id").cast("string")).alias("d")).select("d.a", "d.b")
    assert rows.where(F.col("a") == F.col("b")).count() == 0
    assert spark.range(1).select((F.xxhash64(F.lit(1), F.lit("x")) == _digest(F.lit("x"))["b"]).alias("seeded")).first()[0]


def test_near_duplicates_among_tied_and_null_ids(spark):
    """Near copies of one id, or of none, keep one row, the same in every run; a null id gives way to any other."""
    from hypergraph_spark.llm.simhash import drop_near_duplicates

    words = [f"w{i}" for i in range(120)]
    near = [" ".join([*words, f"end{i}"]) for i in range(3)]
    other = " ".join(f"v{i}" for i in range(120))
    table = spark.createDataFrame([(None, near[0]), (None, near[1]), (7, other), (7, other + " more"), (9, near[2])], "doc_id long, text string")
    got = [sorted(map(repr, drop_near_duplicates(table.repartition(n)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 2
    assert {r["doc_id"] for r in drop_near_duplicates(table).collect()} == {7, 9}


def distinct_similarity(a, b, k=5):
    """Exact Jaccard similarity of two texts' distinct k-word shingles."""
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def kept_of_pairs(spark, pairs):
    """Numbers of the pairs of texts of which drop_near_duplicates keeps one."""
    rows = [(2 * i + j, t, "a") for i, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r["doc_id"] for r in drop_near_duplicates(docs(spark, rows)).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    return {i for i in range(len(pairs)) if 2 * i + 1 not in kept}


def test_links_of_classes_over_many_blocks(spark):
    """A class larger than its blocks keeps every component, however its rows fall into blocks."""
    from hypergraph_spark.llm.simhash import near_duplicate_links

    head = [f"h{i}" for i in range(40)]
    texts = [" ".join([*head, *[f"c{g}x{i}" for i in range(200)], f"e{g}x{j}"]) for g in range(6) for j in range(1 + 7 * g)]
    # A chain, each text like the next only.
    chain = [f"z{i}" for i in range(900)]
    texts += [" ".join([*head, *chain[30 * j : 30 * j + 260]]) for j in range(20)]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if distinct_similarity(texts[i], texts[j]) >= 0.8 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {x: new if y == old else y for x, y in want.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["node"]: r["root"] for r in connected_components(near_duplicate_links(df, block_rows=8)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicate_recall_against_all_pairs(spark):
    """Of all pairs of long texts at 0.8 or more, with edits strewn over them, 0.99 or more are found."""
    rng = random.Random(9)
    pairs = []
    for i in range(300):
        w = [f"q{i}x{j}" for j in range(rng.randrange(90, 700))]
        v = list(w)
        for _ in range(rng.randrange(1, max(2, len(w) // 40))):
            v[rng.randrange(len(v))] = f"new{rng.random()}"
        pairs.append((" ".join(w), " ".join(v)))
    want = {i for i, (a, b) in enumerate(pairs) if distinct_similarity(a, b) >= 0.8}
    got = kept_of_pairs(spark, pairs)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 150


def test_near_duplicates_among_short_texts(spark):
    """One-word edits of texts of 5 to 20 words go exactly if the distinct shingles are similar enough."""
    pairs = []
    for n in range(5, 21):
        for copy in range(4):
            w = [f"t{n}x{copy}x{i}" for i in range(n)]
            pairs.append((" ".join(w), " ".join([*w, "added"])))
            w = [f"u{n}x{copy}x{i}" for i in range(n)]
            pairs.append((" ".join(w), " ".join([*w[:-1], "last"])))
            w = [f"v{n}x{copy}x{i}" for i in range(n)]
            pairs.append((" ".join(w), " ".join([*w[: n // 2], "mid", *w[n // 2 + 1 :]])))
    want = {i for i, (a, b) in enumerate(pairs) if distinct_similarity(a, b) >= 0.8}
    assert len(want) > 40 and kept_of_pairs(spark, pairs) == want


def test_near_duplicates_with_a_repeated_line(spark):
    """A line repeated many times changes few distinct shingles, so the pair is one."""
    pairs = []
    for i, (n, times) in enumerate([(300, 10), (300, 20), (300, 100), (1000, 50)] * 5):
        text = word_salad(7000 + i, n, 100_000)
        pairs.append((text, "\n".join([text, *[word_salad(8000 + i, 10, 100_000)] * times])))
    assert min(distinct_similarity(a, b) for a, b in pairs) > 0.9
    assert kept_of_pairs(spark, pairs) == set(range(len(pairs)))


def test_near_duplicates_of_long_texts_are_exact(spark):
    """Texts beyond the sketch are judged by all their distinct shingles, just above and just below the similarity."""
    pairs = []
    for i in range(120):
        w = [f"l{i}x{j}" for j in range(2000)]
        # A replaced tail changes as many of the 1996 shingles as it has words: 218 leave 0.803, 225 leave 0.797.
        pairs.append((" ".join(w), " ".join([*w[: -(218 + 7 * (i % 2))], *[f"r{i}x{j}" for j in range(218 + 7 * (i % 2))]])))
    want = {i for i, (a, b) in enumerate(pairs) if distinct_similarity(a, b) >= 0.8}
    assert want == set(range(0, 120, 2)) and kept_of_pairs(spark, pairs) == want


def test_style_trees_decide_inside_articles_and_keep_copies(spark):
    rows = [(i, "http://a.example/x", f"<article><p>Own words of page {i}</p><div class='box'>The same offer</div></article>") for i in range(8)]
    rows += [(10 + i, "http://b.example/x", "<body><div><p>Text of a copied page</p></div></body>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words of page {i}" for i in range(8)} | {10: "Text of a copied page", 11: "Text of a copied page"}
