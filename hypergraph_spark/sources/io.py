"""Embedding files: parquet and csv/tsv by Spark, npz for what fits the driver; legacy text."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.operators import linalg as la


def _wide(emb: DataFrame, decimals: int | None = None) -> DataFrame:
    d = len(emb.select("v").first()[0])
    cell = lambda i: F.format_string(f"%.{decimals}f", F.col("v")[i]) if decimals is not None else F.col("v")[i]
    return emb.select("entity_id", *[cell(i).alias(f"dim_{i}") for i in range(d)])


def save_embeddings(emb: DataFrame, path: str, fmt: str = "parquet") -> None:
    """parquet and csv keep full precision, tsv six decimals; npz is one local file."""
    if fmt == "parquet":
        emb.select("entity_id", "v").write.parquet(path)
    elif fmt == "csv":
        _wide(emb).write.csv(path, header=True)
    elif fmt == "tsv":
        _wide(emb, 6).write.csv(path, header=True, sep="\t")
    elif fmt == "npz":
        ids, x = la.to_local(emb)
        np.savez_compressed(path, embeddings=x.astype(np.float32), entity_ids=np.array(ids))
    else:
        raise ValueError(f"unknown format {fmt!r}")


def load_embeddings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, sep="\t" if fmt == "tsv" else ",")
        return df.select("entity_id", F.array(*[F.col(c).cast("double") for c in df.columns if c.startswith("dim_")]).alias("v"))
    if fmt == "npz":
        z = np.load(path, allow_pickle=False)
        return la.to_emb(spark, [str(e) for e in z["entity_ids"]], z["embeddings"])
    raise ValueError(f"unknown format {fmt!r}")


def save_legacy_text(emb: DataFrame, path: str, counts: DataFrame | None = None) -> None:
    """`n dim` header in a file of its own, then `entity [occurrence] v1 v2 ..` lines."""
    n, d = emb.count(), len(emb.select("v").first()[0])
    cols = [F.col("entity_id")]
    if counts is not None:
        emb = emb.join(counts, "entity_id")
        cols.append(F.col("occurrence").cast("string"))
    emb.select(F.concat_ws(" ", *cols, F.transform("v", lambda x: x.cast("string"))).alias("value")).write.text(f"{path}/rows")
    emb.sparkSession.createDataFrame([(f"{n} {d}",)], "value string").coalesce(1).write.text(f"{path}/header")


def save_legacy_npy(emb: DataFrame, path: str, counts: DataFrame | None = None) -> None:
    """One local .npy matrix, its entities as `path.entities` JSON and, with counts, `path.occurences` as .npy."""
    ids, x = la.to_local(emb)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        np.save(f, x.astype(np.float32))
    with open(f"{path}.entities", "w", encoding="utf-8") as f:
        json.dump(ids, f, ensure_ascii=False)
    if counts is not None:
        of = {r["entity_id"]: r["occurrence"] for r in counts.toLocalIterator()}
        with open(f"{path}.occurences", "wb") as f:
            np.save(f, np.array([of[e] for e in ids], np.uint32))


def to_networkx(edges: DataFrame, emb: DataFrame | None = None):
    """A networkx graph, if that library is installed."""
    import networkx as nx

    g = nx.Graph()
    g.add_weighted_edges_from((r["src"], r["dst"], r["weight"]) for r in edges.toLocalIterator())
    if emb is not None:
        for r in emb.toLocalIterator():
            g.add_node(r["entity_id"], embedding=r["v"])
    return g


def to_coo_arrays(sparse: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cols, weights) for tensor libraries."""
    t = sparse.toArrow()
    return tuple(t.column(c).to_numpy() for c in ("row", "col", "weight"))
