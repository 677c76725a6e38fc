"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import NULL_ID, by_bytes, mix, partitions, small_batches, utf8

HASHES = 3
_SALTS = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)


def paragraph_digests(text: bytes, words: int = 8) -> np.ndarray:
    """Distinct 64-bit digests of the text's paragraphs, each cut into runs of at most `words` words.

    Paragraphs are the lines that hold a word; the k-th repeat of a run in a text is hashed with k, so repeats count.
    A text without a word has one digest of its own bytes unless it is empty.
    """
    out, seen = [], {}
    for line in text.split(b"\n"):
        ws = line.split()
        for i in range(0, len(ws), words):
            h = xxhash.xxh3_64_intdigest(b" ".join(ws[i : i + words]))
            k = seen.get(h, 0)
            seen[h] = k + 1
            out.append(xxhash.xxh3_64_intdigest(h.to_bytes(8, "little"), k) if k else h)
    # The whole text counts as one more paragraph: texts that differ anywhere differ in a digest.
    if text:
        out.append(xxhash.xxh3_64_intdigest(text, 1))
    return np.array(out, np.uint64)


_CELL = np.dtype([("k", "<u8"), ("n", "<i4"), ("c", "<u4")])


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _SALTS[3]) >> np.uint64(32)).astype(np.uint32)


def _cells(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES, keys) cell numbers, `cells` an owner: each hash has a third of its owner's cells to itself."""
    third = np.uint64(cells // HASHES)
    return np.stack([owner * cells + (j * third + mix(keys ^ _SALTS[j]) % third).astype(np.int64) for j in range(HASHES)])


def _flip(table: np.ndarray, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
    """Adds (sign 1) or takes out (-1) each key in its owner's sketch."""
    for c in _cells(keys, owner, table.shape[1]):
        flat = table.reshape(-1)
        np.add.at(flat["n"], c, sign)
        np.bitwise_xor.at(flat["k"], c, keys)
        np.bitwise_xor.at(flat["c"], c, _checks(keys))


def sketch(digests: list[np.ndarray], cells: int) -> np.ndarray:
    """(sets, cells) sketches of digest sets: per cell a count, a key XOR and a check XOR."""
    table = np.zeros((len(digests), cells), _CELL)
    keys = np.concatenate([*digests, np.empty(0, np.uint64)])
    _flip(table, keys, np.repeat(np.arange(len(digests)), [len(d) for d in digests]), np.ones(len(keys), np.int32))
    return table


def subtract(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sketches of the differences: what both sets hold cancels out."""
    out = np.empty_like(one)
    out["n"], out["k"], out["c"] = one["n"] - other["n"], one["k"] ^ other["k"], one["c"] ^ other["c"]
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(solved, owner, digest, side): the digests that subtracted sketches hold, side 1 of the first set, -1 of the second.

    Cells that hold one digest are peeled in rounds, all sketches together, until no cell is pure. A sketch is solved
    if nothing is left in it. A sketch is given up after more digests than it has cells.
    """
    table, cells = table.copy(), table.shape[1]
    owners, keys, sides = [], [], []
    for _ in range(2 * cells + 2):
        flat = table.reshape(-1)
        pure = np.flatnonzero((np.abs(flat["n"]) == 1) & (flat["c"] == _checks(flat["k"])))
        if not len(pure):
            break
        got, at = np.unique(np.stack([(pure // cells).astype(np.uint64), flat["k"][pure]]), axis=1, return_index=True)
        owner, side = got[0].astype(np.int64), flat["n"][pure[at]]
        owners.append(owner)
        keys.append(got[1])
        sides.append(side)
        _flip(table, got[1], owner, -side)
    solved = ~((table["n"] != 0) | (table["k"] != 0)).any(axis=1)
    if not owners:
        return solved, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
    return solved, np.concatenate(owners), np.concatenate(keys), np.concatenate(sides)


def differences(one: list[np.ndarray], other: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests only in the first set, only in the second) of each pair, recovered from the pairs' sketches a and b.

    Pairs whose difference does not peel are sketched anew with twice the cells, and so on; a pair that has more cells
    than four times its digests and still does not peel (two digests that fall together in all hashes) is settled by
    comparing its sets.
    """
    n = len(one)
    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo, cells = np.arange(n), a.shape[1]
    total = np.array([len(x) + len(y) for x, y in zip(one, other, strict=True)], np.int64)
    gap = np.array([abs(len(x) - len(y)) for x, y in zip(one, other, strict=True)], np.int64)
    while len(todo):
        # Sketches that cannot hold even the difference in numbers wait for larger ones.
        ready = todo[gap[todo] <= cells]
        again = []
        # Pairs go through in portions of bounded memory.
        step = max(1, (1 << 20) // cells)
        for at in (ready[i : i + step] for i in range(0, len(ready), step)):
            if a.shape[1] == cells:
                tables = subtract(a[at], b[at])
            else:
                tables = subtract(sketch([one[i] for i in at], cells), sketch([other[i] for i in at], cells))
            solved, owner, _, side = peel(tables)
            first[at], second[at] = np.bincount(owner[side > 0], minlength=len(at)), np.bincount(owner[side < 0], minlength=len(at))
            again.append(at[~solved])
        todo = np.concatenate([todo[gap[todo] > cells], *again])
        for i in todo[cells > 4 * total[todo] + 64]:
            first[i], second[i] = len(np.setdiff1d(one[i], other[i])), len(np.setdiff1d(other[i], one[i]))
        todo = todo[cells <= 4 * total[todo] + 64]
        cells *= 2
    return first, second


def likeness(one: list[np.ndarray], other: list[np.ndarray], differ: np.ndarray) -> np.ndarray:
    """1 - differing digests / all digests of each pair; 1 for two empty sets."""
    total = np.array([len(x) + len(y) for x, y in zip(one, other, strict=True)], np.int64)
    return np.where(total == 0, 1.0, 1.0 - differ / np.maximum(total, 1))


def _ranges(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """At most n ascending ids that occur in docs, the smallest first: lower ends of ranges of near equal row counts."""
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    row = docs.agg(F.min(i).alias("low"), F.percentile_approx(i, [k / n for k in range(1, n)] or [0.5], 1000 + 10 * n).alias("cuts")).first()
    return [] if row is None or row["low"] is None else sorted({row["low"], *row["cuts"]})


def version_fingerprints(docs: DataFrame, cells: int = 15, words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_digests, and the recovered
    numbers of digests: lost_edited, new_edited, lost_next, new_next) of every row.

    The fingerprint is the hex of a sketch of `cells` cells (a multiple of HASHES). The sketches of two versions are
    subtracted and peeled, which recovers the digests that only one of them holds; a difference too large for them is
    peeled from larger sketches of the same digests (see differences). A row's edited text has its last floor(n/2) code
    points replaced by the first as many (or all) of the next row's text in ascending id order, after the last
    the first's. near_*: likeness of the row's digests to the edited text's and to the next row's. Null texts
    count as empty. Equal ids follow each other by text; null ids come first. A table of one row is its own
    next; an empty table gives an empty result; other columns are ignored.
    Rows move once, to the task of their id range; the first row of a range also goes to the range before it, so
    that every range knows its successor, and each task streams its sorted rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lows = np.array(_ranges(docs, id_col, partitions(spark)), np.int64)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not len(lows):
        lows = np.array([0], np.int64)

    @F.pandas_udf("array<int>")
    def ranges(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in parts:
            own = np.searchsorted(lows, ids.to_numpy(np.int64), side="right") - 1
            yield pd.Series([[2 * int(b), 2 * ((int(b) - 1) % len(lows)) + 1] if i == lows[b] else [2 * int(b)] for i, b in zip(ids, own, strict=True)])

    # An odd tag marks a copy of a row for the range before its own.
    dealt = src.withColumn("tag", F.explode(ranges("id"))).withColumn("part", F.floor(F.col("tag") / 2).cast("int"))
    # A range is a partition of its own, without hash collisions.
    dealt = dealt.repartitionById(len(lows), F.col("part")).sortWithinPartitions("part", "tag", "id", "text")
    schema = "id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_digests int, lost_edited int, new_edited int, lost_next int, new_next int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the range at hand that still lack a successor
        part, closed = None, False
        for batch in batches:
            ids, no, tags, parts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "no_id", "tag", "part"))
            for row in zip(ids, no, utf8(batch.column(batch.schema.get_field_index("text"))), tags, parts, strict=True):
                if row[4] != part:
                    part, closed = row[4], False
                if closed:  # further copies of the id that starts the next range
                    continue
                if row[3] % 2:
                    closed = True
                held.append(row)
            ready = len(held) - 1
            if ready > 0:
                yield from _digest_rows(held, cells, words, schema_names)
                held = held[-1:]
        if held:
            yield from _digest_rows(held, cells, words, schema_names)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    out = dealt.select("id", "no_id", "text", "tag", "part").mapInArrow(run, schema)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), *schema_names[2:])


def _digest_rows(rows: list[tuple], cells: int, words: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Results of every row but the last and but copies; each one's next is the row after it."""
    texts = [r[2] for r in rows]
    for a, b in by_bytes(texts, 4 << 20):
        b1 = min(b + 1, len(rows))
        own = [paragraph_digests(t, words) for t in texts[a:b1]]
        at = [i for i in range(a, b1 - 1) if not rows[i][3] % 2]
        if not at:
            continue
        lengths, edited = [], []
        for i in at:
            t = texts[i].decode("utf-8", "replace")
            half = len(t) // 2
            lengths.append(len(t))
            edited.append((t[: len(t) - half] + texts[i + 1].decode("utf-8", "replace")[:half]).encode())
        new = [paragraph_digests(t, words) for t in edited]
        mine, nxt = [own[i - a] for i in at], [own[i + 1 - a] for i in at]
        held, changed = sketch(own, cells), sketch(new, cells)
        here, after = np.array(at) - a, np.array(at) + 1 - a
        lost, added = differences(mine, new, held[here], changed)
        lost_next, new_next = differences(mine, nxt, held[here], held[after])
        columns = [
            [rows[i][0] for i in at], [rows[i][1] for i in at], lengths, [hashlib.sha256(t).hexdigest() for t in edited],
            [held[i].tobytes().hex() for i in here], [x.tobytes().hex() for x in changed],
            likeness(mine, new, lost + added), likeness(mine, nxt, lost_next + new_next), [len(d) for d in mine], lost, added, lost_next, new_next,
        ]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int32()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
