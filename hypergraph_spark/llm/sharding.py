"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import hidden

_LCG = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each 64-bit key among `shards`; keys move only into an appended shard."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64).copy()
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * _LCG + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[j[live] < shards]
    return b.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """jump_hash as a column over a BIGINT key."""

    @F.pandas_udf("int")
    def shard(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return shard(key)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", grown: int | None = None, slot_buckets: int = 1024) -> DataFrame:
    """docs with shard, slot and, if `grown` is given, grown_shard (the shard among `grown`).

    Law `key`: the id and the shard count alone decide. Slots are gapless from 0 within a shard: rows
    fall into slot_buckets hash buckets, whose counts give each bucket's offset, so no shard is ever
    ordered in one task. Null ids share one key; repeated ids share a shard and get slots of their own;
    an empty table gives an empty result. Columns of docs named like the results are replaced, all others stay.
    """
    docs, names = hidden(docs, (id_col,), ("shard", "slot", "grown_shard"))
    kept = docs.columns
    key = F.xxhash64(F.coalesce(F.col(id_col), F.lit(-1).cast(docs.schema[id_col].dataType)))
    df = docs.withColumn("__key", key)
    df = df.withColumn("shard", jump_shard(F.col("__key"), shards))
    if grown:
        df = df.withColumn("grown_shard", jump_shard(F.col("__key"), grown))
    # Equal ids may repeat without bound, so the bucket also takes a row's other columns.
    tie = F.xxhash64(*[F.col(c) for c in kept])
    df = df.withColumn("__tie", tie).withColumn("__bucket", F.pmod(F.xxhash64("__key", "__tie"), F.lit(slot_buckets)).cast("int"))
    counts = df.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # At most shards * slot_buckets rows, whatever the input.
    df = df.join(F.broadcast(offsets), (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    within = Window.partitionBy("shard", "__bucket").orderBy("__key", "__tie")
    df = df.withColumn("slot", F.col("__offset") + F.row_number().over(within) - 1)
    made = ["shard", "slot", *(["grown_shard"] if grown else [])]
    return df.select(*kept, *made).toDF(*names, *made)
