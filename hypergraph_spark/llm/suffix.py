"""Exact substring dedup: sorted suffix runs, front-coded, merged by loser trees that know common prefixes."""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import NULL_ID, by_bytes, hidden, mix, partitions, small_batches, span_hashes, utf8

GRAM = 40
_HEAD = struct.Struct("<qqiHHH")  # id, text hash, position, left length, common prefix, tail length


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if w > size else out


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen GRAM-byte strings of data: every `length`-byte string holds one, and which depends on its bytes alone.

    A position is chosen if its hash is the least (ties all) of a window of length - GRAM + 1 positions.
    """
    w = length - GRAM + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(len(data) - GRAM + 1)
    h = span_hashes(data, at, at + GRAM)
    small = (h >> np.uint64(32)).astype(np.uint32)
    least = _sliding_min(small, w)
    # Position i is the least of some window if the greatest of the minima of its windows is its own value.
    greatest = ~_sliding_min(np.concatenate((np.full(w - 1, 0xFFFFFFFF, np.uint32), ~least, np.full(w - 1, 0xFFFFFFFF, np.uint32))), w)
    chosen = np.flatnonzero(greatest == small)
    return chosen, h[chosen]


def _text_anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, positions, hashes); long texts go through in overlapping parts."""
    step = 1 << 20
    # Short texts are hashed together: strings across their seams are chosen needlessly and dropped.
    for a, b in by_bytes(texts, step):
        if b - a == 1 and len(texts[a]) > 2 * step:
            t, found = texts[a], []
            for s in range(0, len(t), step):
                pos, h = anchors(np.frombuffer(t[max(0, s - length) : s + step + 2 * length], np.uint8), length)
                found.append(np.stack([(pos + max(0, s - length)).astype(np.uint64), h]))
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield a, both[0].astype(np.int64), both[1]
            continue
        own = [i for i in range(a, b) if len(texts[i]) >= length]
        if not own:
            continue
        data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in own])
        pos, h = anchors(data, length)
        which = np.searchsorted(ends, pos, side="right")
        inside = pos + GRAM <= ends[which]
        pos, h, which = pos[inside], h[inside], which[inside]
        cuts = np.searchsorted(which, np.arange(len(own) + 1))
        for k, i in enumerate(own):
            if cuts[k] < cuts[k + 1]:
                yield i, pos[cuts[k] : cuts[k + 1]] - (ends[k] - len(texts[i])), h[cuts[k] : cuts[k + 1]]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which the first `known` bytes are known equal."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    # Bisect by slices, which compare at memory speed.
    lo, hi = known, most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class LoserTree:
    """Merges sorted runs of (prefix length shared with the run's previous string, string, payload).

    Every loser remembers how many bytes it shares with the string that beat it. Two challengers that were last
    beaten by the same winner compare these lengths first: the longer is smaller; only if they are equal are bytes
    compared, from that length on. No byte of a known prefix is read again.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.shared = [0] * self.k
        self.losers = [-1] * self.k

    def _beats(self, a: int, b: int) -> bool:
        """Whether a's head comes before b's; sets the loser's shared length."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        if self.shared[a] != self.shared[b]:
            return self.shared[a] > self.shared[b]
        n = common_prefix(x[1], y[1], self.shared[a])
        first = x[1][n : n + 1] <= y[1][n : n + 1]
        self.shared[b if first else a] = n
        return first

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(prefix length shared with the previous string out, string, payload) in order."""
        if not self.runs:
            return
        win = self._play(1) if self.k > 1 else 0
        while self.heads[win] is not None:
            yield self.shared[win], self.heads[win][1], self.heads[win][2]
            self.heads[win] = head = next(self.runs[win], None)
            # What a run says of its next string holds against the string just put out.
            self.shared[win] = head[0] if head else 0
            node = (win + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._beats(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2


def _encode(entries: list[tuple[bytes, bytes, int, int, int]], before: bytes = b"") -> bytes:
    """A part of a sorted run, front-coded: each suffix as the length it shares with the one before and the rest."""
    out = []
    for key, left, doc, th, pos in entries:
        n = common_prefix(before, key, 0)
        out += [_HEAD.pack(doc, th, pos, len(left), n, len(key) - n), left, key[n:]]
        before = key
    return b"".join(out)


def _decode(blobs: list[bytes]) -> Iterator[tuple[int, bytes, tuple]]:
    """The entries of a run's parts in order; what the parts say of shared prefixes is taken as it is."""
    before = b""
    for blob in blobs:
        at = 0
        while at < len(blob):
            doc, th, pos, nleft, n, rest = _HEAD.unpack_from(blob, at)
            at += _HEAD.size
            left = blob[at : at + nleft]
            at += nleft
            before = before[:n] + blob[at : at + rest]
            at += rest
            yield n, before, (doc, th, pos, left)


class _Entries:
    """Entries in suffix order as flat arrays, some 200 bytes each, so that a very common anchor fits in a task."""

    def __init__(self, reach: int):
        self.reach = reach
        self.shared, self.size, self.nleft, self.pos = array("i"), array("i"), array("i"), array("i")
        self.doc, self.th, self.lefts = array("q"), array("q"), bytearray()

    def add(self, shared: int, key: bytes, payload: tuple[int, int, int, bytes]) -> None:
        doc, th, pos, left = payload
        for column, x in ((self.shared, shared), (self.size, len(key)), (self.nleft, len(left)), (self.pos, pos), (self.doc, doc), (self.th, th)):
            column.append(x)
        self.lefts += left[::-1].ljust(self.reach, b"\0")

    def __len__(self) -> int:
        return len(self.pos)


def _left_hashes(lefts: np.ndarray, rows: np.ndarray, o: int) -> np.ndarray:
    """Hashes of the first o bytes of the given rows, in portions."""
    out = np.zeros(len(rows), np.uint64)
    weights = _POWER[:o]
    for a in range(0, len(rows), 8192):
        out[a : a + 8192] = ((lefts[rows[a : a + 8192], :o].astype(np.uint64) + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64)
    return out


_POWER = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _resolve(entries: _Entries, length: int) -> np.ndarray:
    """Rows (id, text hash, start, end) of the bytes that the anchors' repeated strings cover.

    The entries are one or more whole groups of equal anchors in suffix order. For a start `o` bytes before its
    anchor, two entries hold the same string if they share length - o bytes after the anchor (a segment of the
    suffix order, by the shared prefixes) and o bytes before it (a hash of the reversed left context).
    """
    n, reach = len(entries), length - GRAM
    shared = np.array(entries.shared, np.int64) - 8
    shared[0] = -8
    size, nleft = np.array(entries.size, np.int64) - 8, np.array(entries.nleft, np.int64)
    group = np.cumsum(shared < GRAM)
    lefts = np.frombuffer(entries.lefts, np.uint8).reshape(n, reach)
    # All offsets' hashes at once take 1.3 KB an entry: only for as many as usually go together.
    every = np.cumsum((lefts.astype(np.uint64) + np.uint64(1)) * _POWER[:reach], axis=1, dtype=np.uint64) if n <= 40_000 else None
    best = np.full((2, n), -1, np.int64)  # least and greatest start offset that repeats
    for way, offsets in ((0, range(reach + 1)), (1, range(reach, -1, -1))):
        live = np.arange(n)
        for o in offsets:
            fits = live[(nleft[live] >= o) & (size[live] >= length - o)]
            if not len(fits):
                continue
            # A segment breaks where neighbours share less; group numbers are part of it.
            seg = np.cumsum(shared < length - o)[fits].astype(np.uint64)
            left = _left_hashes(lefts, fits, o) if every is None else every[fits, o - 1] if o else np.zeros(len(fits), np.uint64)
            key = mix(mix(left) + seg * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.concatenate(([True], k[1:] != k[:-1]))
            klass = np.cumsum(new) - 1
            many = np.bincount(klass)[klass] > 1
            hit = fits[order[many]]
            hit = hit[best[way, hit] < 0]
            best[way, hit] = o
            # A group is looked at again while one of its entries has no answer; its others serve as partners.
            need = np.zeros(group[-1] + 1, bool)
            if way == 0:
                need[group[best[0] < 0]] = True
            else:
                need[group[(best[0] >= 0) & (best[1] < 0)]] = True
            live = np.flatnonzero(need[group])
            if not len(live):
                break
    at = np.flatnonzero((best[0] >= 0) & (best[1] >= 0))
    pos = np.array(entries.pos, np.int64)[at]
    return np.stack([np.array(entries.doc, np.int64)[at], np.array(entries.th, np.int64)[at], pos - best[1, at], pos + length - best[0, at]], axis=1)


def _settle(entries: list[tuple[bytes, bytes, int, int, int]], length: int) -> tuple[list[tuple], list[tuple[int, int, int, int]]]:
    """(entries to merge, spans found): of sorted entries, those alike in their whole context are repeated there.

    Their spans are the widest an anchor can have, so one of them goes on, as a partner to entries of other runs.
    """
    kept, spans, i, reach = [], [], 0, length - GRAM
    while i < len(entries):
        key, left = entries[i][:2]
        j = i + 1
        while j < len(entries) and entries[j][0] == key and entries[j][1] == left:
            j += 1
        if j > i + 1 and len(key) == 8 + length and len(left) == reach:
            spans += [(doc, th, pos - reach, pos + length) for _, _, doc, th, pos in entries[i:j]]
            kept.append(entries[i])
        else:
            kept += entries[i:j]
        i = j
    return kept, spans


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = 200, run_bytes: int = 48 << 20) -> tuple[DataFrame, DataFrame]:
    """(keyed docs, spans): docs with __id and __th, and (__id, __th, spans array<struct<a, b>>) of the repeated bytes.

    1. Anchors. Every `length`-byte string holds an anchor, a GRAM-byte string chosen by content. Only anchors
       that occur twice can lie in a repeated string; the others and all text around them are never sorted.
    2. Sorted runs. Each task sorts the suffixes (up to `length` bytes, behind 8 bytes of the anchor's hash, which
       spread the ranges evenly) of its remaining anchors and writes front-coded runs, one per range of keys.
       Entries of a run that agree in their whole context settle each other; one of them goes on.
    3. Merge. A range's runs go through a loser tree; the shared prefixes it knows anyway give the suffix order's
       segments, from which the repeated strings around each anchor follow.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__th", F.xxhash64(text))
    src = keyed.select("__id", "__th", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            got = list(_text_anchors(utf8(batch.column(2)), length))
            if got:
                times = [len(p) for _, p, _ in got]
                which = np.repeat([i for i, _, _ in got], times)
                g, pos = np.concatenate([h for _, _, h in got]), np.concatenate([p for _, p, _ in got])
                # Of an anchor that a batch holds more than once, one row goes to be counted; the others, proven
                # already, are spread by a salt, so a very common passage does not meet in one task.
                _, first, back, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
                salt = 1 + (which * 31 + pos) % 1024
                salt[first] = 0
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(n[back] > 1), pa.array(ids[which]), pa.array(ths[which]), pa.array(pos.astype(np.int32))], names=["g", "salt", "proven", "__id", "__th", "pos"])

    # Texts too short for a string are out before Python sees them.
    found = src.where(F.octet_length("text") >= length).mapInArrow(find, "g long, salt int, proven boolean, __id long, __th long, pos int")
    return keyed, _spans(found, keyed, length, run_bytes, ranges)


def _spans(found: DataFrame, keyed: DataFrame, length: int, run_bytes: int, ranges: int) -> DataFrame:
    twice = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g", "salt"))).where((F.col("n") > 1) | F.col("proven"))
    wanted = twice.groupBy("__id", "__th").agg(F.collect_set("pos").alias("__pos"))
    # All columns go along, so that this shuffle of the texts is the one that the spans are later joined to.
    names = [c for c in keyed.columns if c not in ("__id", "__th")]
    texts = keyed.join(wanted, ["__id", "__th"]).select("__id", "__th", "__pos", *names)
    text_at = 3 + names.index("text")
    reach = length - GRAM

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(ranges)]
        size = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, number, held
            for r, entries in enumerate(held):
                entries.sort()
                kept, spans = _settle(entries, length)
                blobs = [_encode(kept[a : a + 4096], kept[a - 1][0] if a else b"") for a in range(0, len(kept), 4096)]
                rows = [(r, number, k, blob) for k, blob in enumerate(blobs)]
                if spans:
                    rows.append((-1 - r, number, 0, np.array(spans, np.int64).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["range", "run", "seq", "blob"])
            number += 1
            size, held = 0, [[] for _ in range(ranges)]

        for batch in batches:
            ids, ths, positions = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, t in enumerate(utf8(batch.column(text_at))):
                at = np.array(positions[i].as_py(), np.int64)
                g = span_hashes_at(t, at)
                where = (g >> np.uint64(32)).astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)
                for p, h, r in zip(at.tolist(), g.tolist(), where.tolist(), strict=True):
                    key = h.to_bytes(8, "big") + t[p : p + length]
                    held[r].append((key, t[max(0, p - reach) : p], ids[i], ths[i], p))
                    size += 400
                if size > run_bytes:
                    yield from flush()
        yield from flush()

    coded = texts.mapInArrow(runs, "range int, run int, seq int, blob binary")
    coded = coded.withColumn("run", F.struct(F.spark_partition_id().alias("p"), "run"))
    # A range is a partition of its own, without hash collisions; settled spans go with theirs.
    coded = coded.repartitionById(ranges, F.when(F.col("range") < 0, -1 - F.col("range")).otherwise(F.col("range"))).sortWithinPartitions("range", "run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], names=["__id", "__th", "a", "b"])

        def ranges_of() -> Iterator[list[list[bytes]]]:
            at, run, blobs = None, None, []
            for batch in batches:
                for r, p, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if r < 0:
                        settled.append(blob)
                        continue
                    if r != at:
                        if blobs:
                            yield blobs
                        at, run, blobs = r, None, []
                    if (p, n) != run:
                        run = (p, n)
                        blobs.append([])
                    blobs[-1].append(blob)
            if blobs:
                yield blobs

        settled: list[bytes] = []
        for blobs in ranges_of():
            while settled:
                yield out(np.frombuffer(settled.pop(), np.int64).reshape(-1, 4))
            entries = _Entries(reach)
            for n, key, p in LoserTree([_decode(b) for b in blobs]):
                # Whole groups only: a group ends where the anchor's own bytes differ.
                if n < 8 + GRAM and len(entries) >= 20_000:
                    yield out(_resolve(entries, length))
                    entries = _Entries(reach)
                entries.add(n, key, p)
            if len(entries):
                yield out(_resolve(entries, length))
        while settled:
            yield out(np.frombuffer(settled.pop(), np.int64).reshape(-1, 4))

    spans = coded.select("range", "run.p", "run.run", "blob").mapInArrow(merge, "__id long, __th long, a int, b int")
    return spans.groupBy("__id", "__th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def span_hashes_at(text: bytes, at: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings at the positions; blake2b, so that equal heads mean equal anchors."""
    out = np.empty(len(at), np.uint64)
    for k, p in enumerate(at.tolist()):
        out[k] = int.from_bytes(hashlib.blake2b(text[p : p + GRAM], digest_size=8).digest(), "big")
    return out


def drop_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with kept (BINARY: the text's remaining UTF-8 bytes), n_bytes, n_removed, n_spans and spans (a, b).

    Every byte covered by a `length`-byte string that also starts anywhere else in the table, the same document
    included, is removed; matches never cross documents. A null text counts as empty. Repeated rows (equal id and
    text) are documents of their own and so repeat each other. Null ids are kept. An empty table gives an empty
    result. Extra columns stay; those named like the results are replaced.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    made = ("kept", "n_bytes", "n_removed", "n_spans", "spans")
    docs, own = hidden(docs, ("doc_id", "text"), made)
    names = docs.columns
    keyed, spans = repeated_spans(docs, length)
    df = keyed.join(spans.withColumnRenamed("spans", "__spans"), ["__id", "__th"], "left")
    text = F.coalesce(F.col("text"), F.lit(""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(batch.num_columns - 2)
            kept, removed, runs = [], [], []
            for raw, s in zip(utf8(t), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                merged = _cover([(x["a"], x["b"]) for x in s or []])
                ends = [0, *[b for _, b in merged]]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*[a for a, _ in merged], len(raw)], strict=True)))
                removed.append(sum(b - a for a, b in merged))
                runs.append([{"a": a, "b": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(kept, pa.binary()), pa.array([len(x) for x in utf8(t)], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                names=[*names, *made],
            )

    types = ", ".join(f"`{c}` {t}" for c, t in df.select(*names).dtypes)
    return df.select(*names, text.alias("__text"), "__spans").mapInArrow(cut, types + ", kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<a:int,b:int>>").toDF(*own, *made)
