"""Vantage-point trees over 64-bit fingerprints under Hamming distance, as shards of a distributed exact join."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import mix

FULL = 0xFFFFFFFFFFFFFFFF
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)


@dataclass
class VPTree:
    """Inner nodes (pivot, threshold, left, right; children below 0 are leaf -1 - child) over the bits of mask.

    A point lies left of a node if its distance to the pivot is at most the threshold. Under a mask the distance
    is that of the masked bits: a pseudometric, so the triangle bounds hold as they do for all bits.
    """

    mask: int
    radius: int
    pivots: np.ndarray
    thresholds: np.ndarray
    lefts: np.ndarray
    rights: np.ndarray
    leaves: int
    #: Leaves that hold more than asked for, as no split saves work.
    whole: set[int] = field(default_factory=set)

    def home(self, points: np.ndarray) -> np.ndarray:
        """Each point's own leaf."""
        at = np.full(len(points), 0 if len(self.pivots) else -1, np.int64)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            left = np.bitwise_count((points[live] ^ self.pivots[node]) & np.uint64(self.mask)) <= self.thresholds[node]
            at[live] = np.where(left, self.lefts[node], self.rights[node])
            live = live[at[live] >= 0]
        return -1 - at

    def graft(self, subtrees: dict[int, VPTree]) -> VPTree:
        """This tree with leaves replaced by trees."""
        pivots, thresholds, lefts, rights = [self.pivots], [self.thresholds], [self.lefts.copy()], [self.rights.copy()]
        nodes, leaves, whole = len(self.pivots), self.leaves, set(self.whole)
        at: dict[int, int] = {}
        for leaf, t in subtrees.items():
            number = np.concatenate(([leaf], np.arange(leaves, leaves + t.leaves - 1))).astype(np.int64)
            whole |= {int(number[x]) for x in t.whole}
            if not len(t.pivots):
                continue
            at[leaf] = nodes
            for own, out in ((t.lefts, lefts), (t.rights, rights)):
                out.append(np.where(own >= 0, own + nodes, -1 - number[np.maximum(-1 - own, 0)]))
            pivots.append(t.pivots)
            thresholds.append(t.thresholds)
            nodes += len(t.pivots)
            leaves += t.leaves - 1
        root = at.get(0) if not len(self.pivots) else None
        for side in (lefts, rights):
            if at and root is None:
                to = np.full(self.leaves, -1, np.int64)
                to[list(at)] = list(at.values())
                leaf = np.maximum(-1 - side[0], 0)
                side[0] = np.where((side[0] < 0) & (to[leaf] >= 0), to[leaf], side[0])
        return VPTree(self.mask, self.radius, np.concatenate(pivots), np.concatenate(thresholds), np.concatenate(lefts), np.concatenate(rights), leaves, whole)

    def visit(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf): each point's own leaf and every later leaf that its radius reaches.

        Of two points within the radius, the one whose leaf comes first visits the other's: every such pair meets.
        """
        idx, leaf = [], []
        todo = [(0 if len(self.pivots) else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                idx.append(at)
                leaf.append(np.full(len(at), -1 - node))
                continue
            d = np.bitwise_count((points[at] ^ self.pivots[node]) & np.uint64(self.mask)).astype(np.int16)
            t, r = self.thresholds[node], self.radius
            left = d <= t
            # Its own leaf lies left: it may reach right. Its own leaf lies right: no earlier leaf is visited.
            to_left = np.where(home, left, d - r <= t)
            to_right = np.where(home, ~left | (d + r > t), d + r > t)
            todo.append((self.lefts[node], at[to_left], home[to_left]))
            todo.append((self.rights[node], at[to_right], home[to_right] & ~left[to_right]))
        if not idx:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(idx), np.concatenate(leaf)


def build_tree(sample: np.ndarray, rows: int, mask: int, radius: int, leaf_rows: int, seed: int = 7) -> VPTree:
    """A tree fitted on a sample of `rows` points, split until a leaf is expected to hold leaf_rows at most.

    Of some random pivots and all thresholds, a node takes the pair that leaves the fewest comparisons, points that
    straddle the boundary counted on both sides; it stays whole if no split saves a twentieth.
    """
    rng = np.random.default_rng(seed)
    scale = rows / max(1, len(sample))
    pivots, thresholds, lefts, rights, whole = [], [], [], [], set()
    leaves = 0
    todo = [(sample, -1, 0)]
    while todo:
        points, parent, side = todo.pop()
        best = None
        if len(points) * scale > leaf_rows and len(points) >= 16:
            for p in points[rng.integers(0, len(points), 6)]:
                d = np.bitwise_count((points ^ p) & np.uint64(mask))
                h = np.bincount(d, minlength=66)
                low = np.cumsum(h)
                high = len(points) - low
                out = np.concatenate((low, np.full(radius, low[-1])))
                back = np.concatenate((np.zeros(radius, np.int64), low))
                reach = out[: len(low)] - back[: len(low)]  # left points within the radius of the boundary: t-r+1..t
                work = low.astype(float) ** 2 + high.astype(float) ** 2 + 2.0 * reach * high
                t = int(np.argmin(work))
                if best is None or work[t] < best[0]:
                    best = (work[t], p, t, d)
        if best is None or best[0] > 0.95 * len(points) ** 2:
            me = -1 - leaves
            if best is not None:
                whole.add(leaves)
            leaves += 1
        else:
            me = len(pivots)
            pivots.append(best[1])
            thresholds.append(best[2])
            lefts.append(0)
            rights.append(0)
            todo.append((points[best[3] > best[2]], me, 1))
            todo.append((points[best[3] <= best[2]], me, 0))
        if parent >= 0:
            (rights if side else lefts)[parent] = me
    return VPTree(mask, radius, np.array(pivots, np.uint64), np.array(thresholds, np.int16), np.array(lefts, np.int64), np.array(rights, np.int64), leaves, whole)


#: Trees are sent to every task; if they would be larger, leaves are.
TREE_BYTES, NODE_BYTES = 64 << 20, 26


def fit_trees(fps: DataFrame, rows: int, masks: Sequence[int], radius: int, leaf_rows: int, sample_rows: int) -> list[VPTree]:
    """Trees over the rows of fps (fp BIGINT), whose leaves hold some leaf_rows points whatever the number of rows.

    The first levels are fitted on a sample of sample_rows points (those of the smallest hash). Then every leaf that
    holds over twice leaf_rows is fitted again on a sample of its own points, all such leaves at once and on the
    executors, until none is left that a split would help. The driver holds the trees: TREE_BYTES at most, as leaves
    grow beyond some leaf_rows * TREE_BYTES / (2 * NODE_BYTES) rows, 2.5 billion by default.
    """
    leaf_rows = max(leaf_rows, -(-len(masks) * rows * NODE_BYTES // TREE_BYTES))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()], np.int64).view(np.uint64)
    trees = [build_tree(sample, rows, m, radius, leaf_rows) for m in masks]
    if rows <= len(sample):
        return trees

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(t.leaves, np.int64) for t in trees]
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, total in zip(trees, totals, strict=True):
                total += np.bincount(t.home(points), minlength=t.leaves)
        for i, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some), pa.array(total[some])], names=["tree", "leaf", "n"])

    while True:
        found = fps.select("fp").mapInArrow(count, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * leaf_rows).collect()
        full = {(r["tree"], r["leaf"]): r["n"] for r in found if r["leaf"] not in trees[r["tree"]].whole}
        if not full:
            return trees
        shares = [np.zeros(t.leaves) for t in trees]
        for (i, leaf), n in full.items():
            shares[i][leaf] = sample_rows / n

        def pick(batches: Iterator[pa.RecordBatch], shares=shares) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                draw = mix(points ^ np.uint64(0xA0761D6478BD642F)) / 2.0**64
                for i, t in enumerate(trees):
                    leaf = t.home(points)
                    mine = np.flatnonzero(draw < shares[i][leaf])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), i, np.int32)), pa.array(leaf[mine]), pa.array(points[mine].view(np.int64))], names=["tree", "leaf", "fp"])

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            i, leaf = int(group["tree"].iloc[0]), int(group["leaf"].iloc[0])
            t = build_tree(group["fp"].to_numpy(np.int64).view(np.uint64), full[i, leaf], masks[i], radius, leaf_rows, seed=leaf)
            return pd.DataFrame({"tree": [i], "leaf": [leaf], "blob": [pickle.dumps(t)]})

        made = fps.select("fp").mapInArrow(pick, "tree int, leaf long, fp long").groupBy("tree", "leaf").applyInPandas(fit, "tree int, leaf long, blob binary").collect()
        subtrees: list[dict[int, VPTree]] = [{} for _ in trees]
        for r in made:
            t = pickle.loads(r["blob"])
            if not len(t.pivots):
                t.whole = {0}
            subtrees[r["tree"]][r["leaf"]] = t
        for i, leaf in full:  # a leaf of which the sample drew nothing stays as it is
            subtrees[i].setdefault(leaf, VPTree(masks[i], radius, np.empty(0, np.uint64), np.empty(0, np.int16), np.empty(0, np.int64), np.empty(0, np.int64), 1, {0}))
        trees = [t.graft(s) for t, s in zip(trees, subtrees, strict=True)]


def _spanning(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (smallest first) of a star for every linked set of points: a search that compares each point once with all left."""
    left = np.arange(len(points))
    values = points
    out = []
    while len(left) > 1:
        root, frontier, members = left[-1], [values[-1]], []
        left, values = left[:-1], values[:-1]
        while frontier and len(left):
            near = np.bitwise_count(values ^ frontier.pop()) <= radius
            if near.any():
                members += left[near].tolist()
                frontier += list(values[near])
                left, values = left[~near], values[~near]
        out += [(root, m) for m in members]
    return out


def link_fingerprints(fps: DataFrame, radius: int = 2, leaf_rows: int = 2048, sample_rows: int = 16_384, block_rows: int = 4096) -> DataFrame:
    """(u, v): links that join every two of the distinct fingerprints `fp` (BIGINT) at most `radius` bits apart.

    Links between fingerprints of one shard form a star for each linked set, so all links imply the same components
    as all pairs do, without writing the pairs out. With radius >= 2 the 64 bits are read as two halves, of which
    one differs in at most radius // 2 bits: a tree over each half searches at that smaller radius, and candidates
    are verified on all bits. The trees are fitted on bounded samples (see fit_trees) and index every row. A shard
    over block_rows is dealt out as pairs of blocks, each a task's worth. Null fingerprints are ignored.
    """
    spark = fps.sparkSession
    fps = fps.where(F.col("fp").isNotNull())
    rows = fps.count()
    if rows < 2:
        return spark.createDataFrame([], "u long, v long")
    masks = HALVES if radius >= 2 else HALVES if radius == 1 else (FULL,)
    inner = radius // len(masks) if len(masks) > 1 else radius
    trees = fit_trees(fps, rows, masks, inner, leaf_rows, sample_rows)

    def visit(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = 0
        for tree in trees:
            idx, leaf = tree.visit(points)
            yield idx, leaf + first
            first += tree.leaves

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(t.leaves for t in trees), np.int64)
        for batch in batches:
            for _, leaf in visit(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                total += np.bincount(leaf, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["leaf", "n"])

    # One number a shard: as bounded as the trees.
    sizes = {r["leaf"]: r["n"] for r in fps.select("fp").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    chunks = np.ones(max(sizes, default=0) + 1, np.int64)
    for leaf, n in sizes.items():
        chunks[leaf] = -(-n // block_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            spread = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for idx, leaf in visit(points):
                k = chunks[leaf]
                own = (spread[idx] % k.astype(np.uint64)).astype(np.int64)
                # Block pair (i, j), i <= j: a row of block c goes to all pairs that hold c.
                rep = np.repeat(np.arange(len(idx)), k)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
                lo, hi = np.minimum(own[rep], other), np.maximum(own[rep], other)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[rep], pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(points[idx[rep]].view(np.int64), pa.int64())], names=["leaf", "i", "j", "fp"])

    def link(group: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(group["fp"].to_numpy(np.int64)).view(np.uint64)
        signed = points.view(np.int64)
        found = np.array(_spanning(points, radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": signed[found[:, 0]], "v": signed[found[:, 1]]})

    dealt = fps.select("fp").mapInArrow(deal, "leaf long, i int, j int, fp long")
    return dealt.groupBy("leaf", "i", "j").applyInPandas(link, "u long, v long")
