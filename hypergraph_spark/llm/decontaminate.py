"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import by_bytes, hidden, small_batches, span_hashes, utf8, word_count

#: Items travel to every task; a benchmark whose index would be larger is searched in slices, one pass over docs each.
MAX_INDEX_BYTES = 64 << 20
#: Index bytes an item takes besides its text, and for each of its words (a sketch hash and its owner, at any threshold).
ITEM_BYTES, WORD_BYTES = 200, 16


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8, split at ASCII white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


@dataclass
class _Partition:
    """Items of like size: their shingle length, and their MinHash sketches as sorted (hash, item) arrays.

    `most` is the largest hash of any sketch: a document's MinHash sketch for this partition is its hashes up to there.
    """

    k: int
    hashes: np.ndarray
    items: np.ndarray
    most: np.uint64


@dataclass
class Index:
    """Items as UTF-8 text, and their sketches by size. All that travels is arrays and texts; see nbytes."""

    texts: list[bytes]
    parts: list[_Partition]
    size: int

    @property
    def nbytes(self) -> int:
        return sum(len(t) + ITEM_BYTES for t in self.texts) + sum(p.hashes.nbytes + p.items.nbytes for p in self.parts)


def _shingles(ws: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def build_index(items: list[str | None], k: int, threshold: float) -> Index:
    """Partitions by size: items under k words by their own length, others by powers of two of their shingles.

    An item of n distinct shingles is sketched by its floor((1 - threshold) n) + 1 smallest hashes. A document that
    holds `threshold` of the shingles misses fewer than that, so it meets the sketch: no candidate is lost. MinHash
    sketches of one size for whole documents would lose short items in long ones; a document's sketch is all of its
    hashes as small as those that the partition's items are sketched by, so it grows with the document.
    Items without a word have no partition and match nothing.
    """
    made: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
    words = [words_of(t) for t in items]
    for i, ws in enumerate(words):
        if ws:
            n = min(k, len(ws))
            own = list(_shingles(ws, n))
            ends = np.cumsum([len(s) + 1 for s in own]) - 1
            h = np.sort(span_hashes(np.frombuffer(b" ".join(own), np.uint8), np.concatenate(([0], ends[:-1] + 1)), ends))
            made[n, len(own).bit_length()].append((i, h[: math.floor((1 - threshold) * len(own) + 1e-9) + 1]))
    parts = []
    for (n, _), members in sorted(made.items()):
        hashes = np.concatenate([h for _, h in members])
        owner = np.repeat(np.array([i for i, _ in members], np.int32), [len(h) for _, h in members])
        order = np.argsort(hashes, kind="stable")
        parts.append(_Partition(n, hashes[order], owner[order], hashes.max()))
    return Index([b" ".join(ws) for ws in words], parts, k)


def _search(texts: list[bytes], index: Index, threshold: float, cache: dict[int, set[bytes]]) -> Iterator[tuple[int, int, int, float]]:
    """(text number, item number, shared shingles, containment) over the lower-cased texts. cache: items' shingles."""
    for a, b in by_bytes(texts, 1 << 20):
        words = [t.split() for t in texts[a:b]]
        flat = [w for ws in words for w in ws]
        if not flat:
            continue
        data = np.frombuffer(b" ".join(flat), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        owner = np.repeat(np.arange(b - a), [len(ws) for ws in words])
        candidates: dict[tuple[int, int], int] = {}
        hashed: dict[int, np.ndarray] = {}
        for p in index.parts:
            if len(flat) < p.k:
                continue
            if p.k not in hashed:
                hashed[p.k] = span_hashes(data, starts[: len(flat) - p.k + 1], ends[p.k - 1 :])
            h = hashed[p.k]
            sketched = np.flatnonzero(h <= p.most)
            sketched = sketched[owner[sketched] == owner[sketched + p.k - 1]]  # shingles within one text
            first = np.searchsorted(p.hashes, h[sketched], side="left")
            hit = p.hashes[first] == h[sketched]
            sketched, first = sketched[hit], first[hit]
            last = np.searchsorted(p.hashes, h[sketched], side="right")
            for at, x, y in zip(owner[sketched].tolist(), first.tolist(), last.tolist(), strict=True):
                for i in p.items[x:y].tolist():
                    candidates[at, i] = p.k
        made: dict[int, set[bytes]] = {}
        now = -1
        for (at, i), k in sorted(candidates.items()):
            if at != now:  # one text's shingles at a time
                now = at
                made.clear()
            if k not in made:
                made[k] = _shingles(words[at], k)
            if i not in cache:
                if len(cache) >= 4096:
                    cache.clear()
                cache[i] = _shingles(index.texts[i].split(), k)
            shared = len(made[k] & cache[i])
            if shared >= threshold * len(cache[i]) - 1e-9:
                yield a + at, i, shared, shared / len(cache[i])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns of docs, item_id, shared, containment): every row of docs that holds `threshold` of an item.

    Containment is the share of the item's distinct k-word shingles (lower-cased, split at ASCII white space) found
    anywhere in the whole document; an item under k words is one shingle of its own length. Null or empty texts and
    items match nothing. Repeated rows and items are each reported; null ids pass through; other columns are ignored.
    The benchmark, the stated query set against all rows, is read to the driver in slices of MAX_INDEX_BYTES of index
    and broadcast once each; docs are scanned once a slice, without a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = list(keep)
    src = docs.select(*names, F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("__text"))
    types = ", ".join(f"`{c}` {dict(src.dtypes)[c]}" for c in names) + ", item_id long, shared int, containment double"
    out = None
    for items in _slices(benchmark):
        sent = spark.sparkContext.broadcast((build_index([t for _, t in items], k, threshold), [i for i, _ in items]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, ids = sent.value
            cache: dict[int, set[bytes]] = {}
            for batch in batches:
                found = list(_search(utf8(batch.column(len(names))), index, threshold, cache))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(j).take(at) for j in range(len(names))], pa.array([ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.float64())],
                    names=[*names, "item_id", "shared", "containment"],
                )

        one = src.mapInArrow(run, types)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], types)


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in portions whose index stays under MAX_INDEX_BYTES, an item that is larger by itself alone."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    cost = F.coalesce(F.octet_length("text") + WORD_BYTES * word_count(F.col("text")), F.lit(0)) + ITEM_BYTES
    size = benchmark.agg(F.sum(cost)).first()[0] or 0
    # Half full on average, as hashes deal unevenly.
    n = 1 if size <= MAX_INDEX_BYTES else -(-2 * size // MAX_INDEX_BYTES)
    for i in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        held, full = [], 0
        for r in rows.toLocalIterator():
            own = ITEM_BYTES + (len((r[1] or "").encode("utf-8", "surrogatepass")) + WORD_BYTES * len((r[1] or "").split()))
            if held and full + own > MAX_INDEX_BYTES:
                yield held
                held, full = [], 0
            held.append((r[0], r[1]))
            full += own
        if held:
            yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """docs without the rows that hold a benchmark item (see find_contaminated); clean rows, null texts too, stay as they are."""
    # Two hashes under different seeds, so that no clean row shares a dirty one's by chance.
    docs, names = hidden(docs, ("doc_id", "text"))
    key = ("__a", "__b")
    tagged = docs.withColumn("__a", F.xxhash64(F.col("doc_id"), F.col("text"))).withColumn("__b", F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text")))
    hits = find_contaminated(tagged, benchmark, threshold, k, key).select(*key).distinct()
    return tagged.join(hits, list(key), "left_anti").select(*docs.columns).toDF(*names)
