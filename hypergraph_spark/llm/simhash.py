"""SimHash fingerprints and near-duplicate removal through vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import bit_majority, hidden, materialize, shingle_hashes, signed, small_batches, utf8
from hypergraph_spark.llm.components import connected_components
from hypergraph_spark.llm.vptree import link_fingerprints


def simhash(text: bytes, k: int = 3, seed: int = 42) -> int:
    """The text's 64-bit SimHash: majority bits of XXH64 over its k-word shingles, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=True)]
    return bit_majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, k: int = 3, text_col: str = "text") -> DataFrame:
    """doc_id and fp (the SimHash as a signed BIGINT) of every row; a null text counts as empty, with fp 0."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [signed(simhash(t, k)) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row: documents link where fingerprints differ in at most radius bits.

    component_id is the smallest doc_id reachable, the document's own included. Equal fingerprints collapse before
    the search, so copies cost nothing there. Repeated rows each get a result; null ids do not lower a component's id
    (a component of null ids only has a null id); an empty table gives an empty result; other columns are ignored.
    """
    own = materialize(fingerprints(docs, k), "simhash")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = connected_components(link_fingerprints(distinct, radius))
    linked = materialize(linked, "simhash-roots")
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = named.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


# --- near-duplicate removal -------------------------------------------------------------------------------------

SKETCH = 512
#: Estimates this near the similarity, over four deviations of one, do not settle a pair.
UNSURE = 0.08
#: Pairs with a text of at most so many distinct shingles are found by prefixes of their shingles, not by passages.
SHORT = 64


def _segments(h: np.ndarray, anchors: int, length: int = 12) -> np.ndarray:
    """SimHashes of at most `anchors` passages of a text with shingle hashes h: those of the smallest hashes.

    A passage is `length` shingles from one whose hash is among the text's smallest; near copies share most
    of these starts and, edits being rare, the passages after them.
    """
    if len(h) <= length:
        return np.array([bit_majority(h)], np.uint64) if len(h) else np.zeros(1, np.uint64)
    starts = h[: len(h) - length + 1]
    _, at = np.unique(starts, return_index=True)  # ascending hashes, first places
    at = at[:anchors]
    return np.array([bit_majority(h[a : a + length]) for a in at], np.uint64)


def _bottom(h: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct hashes, upper halves only."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity estimated from two bottom sketches; exact while both hold whole sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        both = both[: max(1, min(SKETCH, len(both)))]
    return len(np.intersect1d(np.intersect1d(a, both, assume_unique=True), b, assume_unique=True)) / len(both)


def _bitmaps(sketches: list[np.ndarray], words: int = 16) -> np.ndarray:
    """A row of 64 * words bits a sketch, those of its hashes set."""
    out = np.zeros((len(sketches), 64 * words), np.uint8)
    for i, x in enumerate(sketches):
        out[i, x % np.uint32(64 * words)] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def _possible(a: int, others: np.ndarray, size: np.ndarray, held: np.ndarray, maps: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the others may be similar to a: bounds that rule out no pair, given distinct shingles (size) and sketches.

    Of two sets the smaller has `similarity` of the larger at least. Of two sketches, which hold at most what their
    union's holds, one lacks at most its size less `similarity` of the larger; a bit set in one bitmap only is a hash
    of one sketch only.
    """
    near = np.minimum(size[others], size[a]) >= similarity * np.maximum(size[others], size[a]) - 1e-9
    at = others[near]
    shared = similarity * np.maximum(held[at], held[a]) - 1e-9
    near[near] = (np.bitwise_count(maps[a] & ~maps[at]).sum(axis=1) <= held[a] - shared) & (np.bitwise_count(maps[at] & ~maps[a]).sum(axis=1) <= held[at] - shared)
    return near


def _prefixes(short: DataFrame, similarity: float) -> DataFrame:
    """(row, class): the shingles of each row (columns row, short: its n distinct hashes) that a similar row may meet it by.

    Two sets of that similarity lack at most n - ceil(similarity n) of either's shingles, so in one order of all
    shingles they share one of the first n - ceil(similarity n) + 1 of both. The rarest come first, so that a line
    that many texts hold brings few of them together; shingles of one row alone are left out after the cut.
    """
    each = short.select("row", F.size("short").alias("size"), F.explode("short").alias("class"))
    each = materialize(each.join(each.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class"), "near-short")
    order = F.row_number().over(Window.partitionBy("row").orderBy("n", "class"))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    return each.withColumn("at", order).where((F.col("at") <= first) & (F.col("n") > 1)).select("row", "class")


def near_duplicate_links(docs: DataFrame, k: int = 5, similarity: float = 0.8, anchors: int = 8, radius: int = 1, block_rows: int = 2048) -> DataFrame:
    """(u, v): links between rows of docs (columns row BIGINT, text), texts being distinct, similar to `similarity` or more.

    Whole-text SimHashes at this similarity differ in up to some 18 of 64 bits, beyond what triangle bounds can
    prune, and in more where lines repeat; so SimHashes of passages are indexed: the vantage-point trees link passages
    at `radius` bits, rows that share a linked passage are candidates, and of those, pairs that sizes and bitmaps do
    not rule out (see _possible) are verified on bottom sketches of
    k-word shingles (exact under 512 distinct shingles, an estimate above). Pairs whose estimate is within UNSURE of
    the similarity are verified on all distinct shingles of both texts.

    Candidates of a class that fit a block are compared there, and a star links each similar set. A larger class is
    compared block by block, then by one row for each set found; rows of its largest set are done with that, and
    the others meet all blocks. So a class of near copies moves each row a few times, whatever its size, and
    only rows that are like few others of a large class cost a comparison with all of it.

    A text of up to SHORT distinct shingles has too few passages for that. Its partners have at most SHORT / similarity
    of them, and all such texts are candidates by shared prefixes, which lose no pair (see _prefixes).
    """
    spark = docs.sparkSession
    small_batches(spark)
    most = math.floor(SHORT / similarity + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shingle_hashes([t.lower() for t in utf8(batch.column(1))], k)
            sets = [np.unique(h) for h in rows]
            size = [len(x) for x in sets]
            short = [x.view(np.int64).tolist() if 0 < len(x) <= most else None for x in sets]
            seg = [_segments(h, anchors).view(np.int64).tolist() if not 0 < len(x) <= SHORT else [] for h, x in zip(rows, sets, strict=True)]
            bottom = [_bottom(h).astype("<u4").tobytes() for h in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(seg, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int64())), pa.array(bottom, pa.binary())], names=["row", "size", "seg", "short", "bottom"])

    made = materialize(docs.select("row", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "row long, size long, seg array<long>, short array<long>, bottom binary"), "near-sketch")
    seg = made.select("row", F.explode(F.array_distinct("seg")).alias("fp"))
    distinct = materialize(seg.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "near-passages")
    linked = connected_components(link_fingerprints(distinct.select("fp"), radius))
    classes = distinct.select("fp", "n").join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("class"))
    shared = classes.join(classes.groupBy("class").agg(F.sum("n").alias("members")).where(F.col("members") > 1), "class").select("fp", "class")
    # Row and class once, whichever passages they share.
    cand = seg.join(shared, "fp").select("class", "row").distinct().withColumn("by", F.lit(0))
    brief = _prefixes(made.where(F.col("short").isNotNull()).select("row", "short"), similarity)
    cand = materialize(cand.unionByName(brief.withColumn("by", F.lit(1))), "near-candidates")
    size = cand.groupBy("by", "class").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    # Written, so that a plain join remains, of which a class with many rows can be split.
    size = materialize(size.select("by", "class", F.ceil(F.col("members") / block_rows).cast("int").alias("k")), "near-classes")
    cand = cand.join(size, ["by", "class"]).withColumn("own", F.pmod(F.xxhash64("row"), F.col("k")).cast("int"))
    cand = cand.select("by", "class", "row", "k", "own")
    sketched = made.select("row", "size", "bottom")

    # 1. Every class in blocks of some block_rows rows: a star for each similar set of a block.
    link = _within(similarity)
    found = materialize(cand.join(sketched, "row").groupBy("by", "class", "own").applyInPandas(link, _LINKS), "near-links")
    if size.where(F.col("k") > 1).isEmpty():
        return _verified(found, docs, k, similarity)
    large = materialize(cand.where(F.col("k") > 1), "near-large")
    # 2. In classes of several blocks, one row for each set found, against each other.
    sets = _sets(large, found)
    stand = sets.groupBy("by", "class", "set").agg(F.min("row").alias("row"))
    blocks = stand.groupBy("by", "class").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("k"))
    stand = stand.join(blocks, ["by", "class"]).join(sketched, "row").withColumn("own", F.pmod(F.xxhash64("row", "class"), F.col("k")).cast("int"))
    stand = stand.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    found = found.unionByName(materialize(stand.groupBy("by", "class", "i", "j").applyInPandas(link, _LINKS), "near-links"))
    # 3. Rows outside their class's largest set have met their own block only: they go to all its blocks.
    sets = materialize(_sets(large, found), "near-sets")
    weight = sets.groupBy("by", "class", "set").agg(F.count(F.lit(1)).alias("n"))
    main = weight.groupBy("by", "class").agg(F.max_by("set", F.struct("n", "set")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    main = main.select("by", "class", "main", F.ceil((F.col("all") - F.col("n")) / block_rows).cast("int").alias("guests")).where(F.col("guests") > 0)
    each = sets.join(main, ["by", "class"]).join(sketched, "row")
    stays = each.select("by", "class", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("j"), F.lit(False).alias("guest"), "set", "row", "size", "bottom")
    goes = each.where(F.col("set") != F.col("main")).withColumn("j", F.pmod(F.xxhash64("row", "class"), F.col("guests")).cast("int"))
    goes = goes.select("by", "class", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "j", F.lit(True).alias("guest"), "set", "row", "size", "bottom")
    met = stays.unionByName(goes).groupBy("by", "class", "i", "j").applyInPandas(_across(similarity), _LINKS)
    return _verified(found.unionByName(materialize(met, "near-links")), docs, k, similarity)


_LINKS = "u long, v long, sure boolean"


def _sets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `set`: the least row that the sure links found join each one to, itself if none."""
    roots = connected_components(found.where("sure").select("u", "v"))
    return rows.join(roots.select(F.col("node").alias("row"), F.col("root").alias("set")), "row", "left").withColumn("set", F.coalesce("set", "row"))


def _verified(found: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    verified = _similar_pairs(found.where(~F.col("sure")).select("u", "v").distinct(), docs, k, similarity)
    return found.where("sure").select("u", "v").unionByName(verified)


def _links(out: list[tuple[int, int, bool]]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["u", "v", "sure"]).astype({"u": "int64", "v": "int64", "sure": "bool"})


class _Sketches:
    """The sketches of a group's rows, and which of them are similar."""

    def __init__(self, group: pd.DataFrame, similarity: float):
        self.rows, self.size = group["row"].to_numpy(np.int64), group["size"].to_numpy(np.int64)
        self.sketches = [np.frombuffer(b, "<u4") for b in group["bottom"]]
        self.held, self.maps = np.fromiter(map(len, self.sketches), np.int64, len(self.sketches)), _bitmaps(self.sketches)
        self.similarity = similarity

    def near(self, a: int, others: np.ndarray) -> Iterator[tuple[int, bool]]:
        """(other, sure) of those that are similar to a, or may be as far as sketches tell."""
        for b in others[_possible(a, others, self.size, self.held, self.maps, self.similarity)].tolist():
            found = sketch_similarity(self.sketches[a], self.sketches[b])
            margin = UNSURE if max(self.held[a], self.held[b]) >= SKETCH else 0
            if found >= self.similarity + margin:
                yield b, True
            elif margin and found >= self.similarity - margin:
                yield b, False


def _within(similarity: float):
    """Links of a star for each similar set of a group's rows, and the pairs that are not sure."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        g = _Sketches(group.drop_duplicates("row"), similarity)
        out, unsure, left, star = [], [], np.arange(len(g.rows)), np.arange(len(g.rows))
        while len(left) > 1:
            root, frontier = left[-1], [left[-1]]
            left = left[:-1]
            while frontier and len(left):
                a = frontier.pop()
                got = []
                for b, sure in g.near(a, left):
                    if sure:
                        got.append(b)
                    else:
                        unsure.append((a, b))
                if got:
                    out += [(g.rows[root], g.rows[b], True) for b in got]
                    star[got] = root
                    frontier += got
                    left = left[~np.isin(left, got)]
        # What other members link needs no verification.
        return _links(out + [(min(g.rows[a], g.rows[b]), max(g.rows[a], g.rows[b]), False) for a, b in unsure if star[a] != star[b]])

    return link


def _across(similarity: float):
    """Links between a group's guests and the rows of other sets: one for each two sets, and the pairs that are not sure."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        g = _Sketches(group, similarity)
        sets, guest = group["set"].to_numpy(np.int64), group["guest"].to_numpy(bool)
        local = np.flatnonzero(~guest)
        joined: set[tuple[int, int]] = set()
        out, unsure = [], []
        for a in np.flatnonzero(guest).tolist():
            for b, sure in g.near(a, local[sets[local] != sets[a]]):
                pair = (min(sets[a], sets[b]), max(sets[a], sets[b]))
                if pair in joined:
                    continue
                if sure:
                    joined.add(pair)
                    out.append((g.rows[a], g.rows[b], True))
                else:
                    unsure.append((pair, (min(g.rows[a], g.rows[b]), max(g.rows[a], g.rows[b]), False)))
        return _links(out + [x for pair, x in unsure if pair not in joined])

    return link


def _similar_pairs(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of rows of docs whose distinct k-word shingles are similar to `similarity` or more."""
    text = docs.select("row", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    both = pairs.join(text.select(F.col("row").alias("u"), F.col("text").alias("a")), "u").join(text.select(F.col("row").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                x, y = (np.unique(h) for h in shingle_hashes([a.lower(), b.lower()], k))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id.

    Exact copies (equal texts, null as empty) collapse first, the smallest doc_id standing for them; what is left is
    linked by near_duplicate_links. Null ids come last in a group, ties go by a hash of the text; rows equal in id and
    text are one. Columns stay
    as they are; an empty table gives an empty result.
    """
    docs, names = hidden(docs, ("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("__h", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    # Copies combine before the shuffle, so a text that a third of the rows repeat does not meet in one task.
    first = keyed.groupBy("__h").agg(F.min("__id").alias("__id"), F.min_by(F.struct(*docs.columns), F.col("__id")).alias("r"))
    # Rows are numbered as they are written, so that a number is one text's alone; 64 bits of hash would not be. The
    # numbers decide nothing: ties between ids go by the text's hash.
    unique = materialize(first.select(F.monotonically_increasing_id().alias("__row"), "__h", "__id", "r.*"), "near-unique")
    links = near_duplicate_links(unique.select(F.col("__row").alias("row"), "text"), k, similarity)
    groups = connected_components(links)
    ids = groups.join(unique.select(F.col("__row").alias("node"), "__id", "__h"), "node")
    best = ids.groupBy("root").agg(F.min(F.struct("__id", "__h", "node")).alias("best")).select("root", F.col("best.node").alias("keep"))
    gone = ids.join(best, "root").where(F.col("node") != F.col("keep")).select(F.col("node").alias("__row"))
    return unique.join(gone, "__row", "left_anti").select(*docs.columns).toDF(*names)
