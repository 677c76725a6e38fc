"""Helpers shared by the corpus operators: durable intermediate tables, byte batches, word hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local master, which has no other machine, may go without: a folder beside the warehouse then."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and outlives executors.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame, needed: Sequence[str], dropped: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """df without the columns `dropped`, and the names of those that stay.

    All but the needed ones have names there that no operator uses, whatever theirs are; toDF gives them back.
    """
    inner = df.toDF(*[c if c in needed else f"__in_{i}" for i, c in enumerate(df.columns)])
    stay = [(a, c) for a, c in zip(inner.columns, df.columns, strict=True) if c not in dropped]
    return inner.select(*[a for a, _ in stay]), [c for _, c in stay]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, as single texts may be long; workers slice them further by bytes.

    Spark reads the setting when a result is computed, so it stays lowered for lazily returned results.
    """
    if int(spark.conf.get(ARROW_ROWS)) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """small_batches for what is computed inside the block; the session's setting comes back after it."""
    before = spark.conf.get(ARROW_ROWS)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def word_count(c: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in c; null counts none."""
    t = F.coalesce(c, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's values as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about `most` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("p", _P), ("q", _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash are usable."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[starts:ends]; equal bytes have equal hashes wherever they lie."""
    p, q = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Hashes of each text's k-word shingles in order, words taken as given (callers lower-case first).

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for a, b in by_bytes(texts, 1 << 20):
        words = [t.split() for t in texts[a:b]]
        flat = [w for ws in words for w in ws]
        if not flat:
            continue
        data = np.frombuffer(b" ".join(flat), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        firsts, lasts, cuts, at = [], [], [0], 0
        for ws in words:
            n = len(ws)
            m = max(1, n - k + 1) if n else 0
            firsts.append(np.arange(at, at + m))
            lasts.append(np.arange(at + min(k, n) - 1, at + min(k, n) - 1 + m))
            cuts.append(cuts[-1] + m)
            at += n
        h = span_hashes(data, starts[np.concatenate(firsts)], ends[np.concatenate(lasts)])
        for i in range(b - a):
            out[a + i] = h[cuts[i] : cuts[i + 1]]
    return out


def bit_majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of h; 0 for none."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
