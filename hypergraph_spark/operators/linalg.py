"""Linear algebra over `emb` (entity_id, v ARRAY<DOUBLE>) and edge DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dense matrix of up to so many bytes may sit on the driver and be broadcast; beyond, rows stay distributed.
LOCAL_BYTES = 256 << 20
EPS = 1e-10


def spmm(edges: DataFrame, emb: DataFrame, weight: str) -> DataFrame:
    """Row src = sum over its edges of weight * row dst. Entities without edges get zeros. Sums combine map-side."""
    x = emb.select(F.col("entity_id").alias("dst"), array_to_vector("v").alias("x"))
    out = edges.select("src", "dst", F.col(weight).alias("w")).join(x, "dst").groupBy("src").agg(Summarizer.sum(F.col("x"), F.col("w")).alias("s"))
    out = out.select(F.col("src").alias("entity_id"), vector_to_array("s").alias("y"))
    zeros = F.transform("v", lambda _: F.lit(0.0))
    return emb.join(out, "entity_id", "left").select("entity_id", F.coalesce("y", zeros).alias("v"))


def spmm_long(edges: DataFrame, x: DataFrame, weight: str, dims: int | None = None) -> DataFrame:
    """spmm in long form (entity_id, dim, x): join and sum. Where dims are known (0 to dims - 1), an edge is one row with all of them, not one a dimension."""
    e = edges.select("src", F.col("dst").alias("entity_id"), F.col(weight).alias("w"))
    if dims is None:
        return e.join(x, "entity_id").groupBy(F.col("src").alias("entity_id"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    wide = x.groupBy("entity_id").agg(*[F.sum(F.when(F.col("dim") == i, F.col("x"))).alias(f"x{i}") for i in range(dims)])
    s = e.join(wide, "entity_id").groupBy(F.col("src").alias("entity_id")).agg(*[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"x{i}") for i in range(dims)])
    return s.select("entity_id", F.posexplode(F.array(*[f"x{i}" for i in range(dims)])).alias("dim", "x")).where(F.col("x").isNotNull())


def l2_long(x: DataFrame) -> DataFrame:
    n = x.groupBy("entity_id").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(EPS)).alias("n"))
    return x.join(n, "entity_id").select("entity_id", "dim", (F.col("x") / F.col("n")).alias("x"))


def norm(v: Column, p: int = 2) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x if p == 2 else F.abs(x)))
    return F.greatest(F.sqrt(total) if p == 2 else total, F.lit(EPS))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector is zero."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalize(emb: DataFrame, method: str) -> DataFrame:
    """Rows scaled by l2 or l1; spectral: l2, then U S of the thin SVD; none."""
    if method == "none":
        return emb
    if method not in ("l2", "l1", "spectral"):
        raise ValueError(f"unknown normalization {method!r}")
    p = 1 if method == "l1" else 2
    out = emb.withColumn("__n", norm(F.col("v"), p)).select("entity_id", F.transform("v", lambda x: x / F.col("__n")).alias("v"))
    return thin_svd(out) if method == "spectral" else out


def gram(emb: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, column sums, X'X): one d x d partial a batch, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                n, s, g = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if g is None else g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "g"])

    part = emb.select("v").mapInArrow(run, "n long, s array<double>, g array<double>")
    summed = part.agg(F.sum("n"), Summarizer.sum(array_to_vector("s")), Summarizer.sum(array_to_vector("g"))).first()
    if summed[0] is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.array(summed[1])
    return summed[0], s, np.array(summed[2]).reshape(len(s), len(s))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def times(emb: DataFrame, m: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """Rows (v - shift) @ m; m is d x k and travels with the task."""

    @F.pandas_udf("array<double>")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            x = np.array(v.tolist(), float).reshape(len(v), -1)
            yield pd.Series(list((x - shift if shift is not None else x) @ m))

    return emb.select("entity_id", apply("v").alias("v"))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest absolute component positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whitening(n: int, sums: np.ndarray, g: np.ndarray, components: int | None) -> tuple[np.ndarray, np.ndarray]:
    mean = sums / n
    cov = (g - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: components or len(values)]
    return mean, _signed(vectors[:, order]) / np.sqrt(np.maximum(values[order], EPS))


def whiten(emb: DataFrame, components: int | None = None) -> DataFrame:
    """Centred rows rotated and scaled to unit covariance; eigenvalues are floored at 1e-10. One row at most: unchanged."""
    n, sums, g = gram(emb)
    if n <= 1:
        return emb
    mean, m = whitening(n, sums, g, components)
    return times(emb, m, mean)


def thin_svd(emb: DataFrame, k: int | None = None, centre: bool = False) -> DataFrame:
    """U S of the rows (first k), by the eigenvectors of the gram matrix."""
    n, sums, g = gram(emb)
    if not n:
        return emb
    mean = sums / n if centre else None
    if centre:
        g = g - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][: k or len(values)]
    return times(emb, _signed(vectors[:, order]), mean)


def rmse(a: DataFrame, b: DataFrame) -> float:
    """Root of the mean squared difference over all cells."""
    j = a.select("entity_id", F.col("v").alias("x")).join(b.select("entity_id", F.col("v").alias("y")), "entity_id")
    sq = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    r = j.agg(F.sum(sq).alias("s"), F.sum(F.size("x")).alias("n")).first()
    return float(np.sqrt(r["s"] / r["n"])) if r["n"] else 0.0


def _row_sums() -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The function that sums a batch of cells; made here so that it travels to the workers whole, as they may lack this module."""

    def sums(at: np.ndarray, of: np.ndarray, w: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[starts], np.add.reduceat(dense[of[order]] * w[order, None], starts, axis=0)

    return sums


class SparseOperator:
    """A sparse n x n matrix whose cells stay in Spark, times dense n x k matrices of the driver (size checked).

    Cells are dealt by row once, by column once more where t_dot is asked for; a product broadcasts the dense side and
    returns each row's sum once. With classes (the place in ids of each of the n entities' class, as of twins) ids and cells
    hold one entity of each class, and only so many rows travel. fetch brings few cells to the driver, then nothing travels.
    """

    def __init__(self, cells: DataFrame, ids: list[str], weight: str = "w", classes: np.ndarray | None = None):
        self.ids, self.n, self.spark, self.classes = ids, len(ids) if classes is None else len(classes), cells.sparkSession, classes
        ix = self.spark.createDataFrame(pd.DataFrame({"e": ids, "i": np.arange(len(ids))})) if ids else None
        if ix is None:
            raise ValueError("the matrix is empty")
        self.index = ix
        r, c = ix.select(F.col("e").alias("src"), F.col("i").alias("r")), ix.select(F.col("e").alias("dst"), F.col("i").alias("c"))
        self.cells = cells.select("src", "dst", F.col(weight).cast("double").alias("w")).join(r, "src").join(c, "dst").select("r", "c", "w").repartition("r").sortWithinPartitions("r").cache()
        self.by_column: DataFrame | None = None
        self.local: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        if classes is not None:
            self.order = np.argsort(classes, kind="stable")
            self.starts = np.searchsorted(classes[self.order], np.arange(len(ids)))

    def fetch(self, limit: int = LOCAL_BYTES // 2) -> SparseOperator:
        """The cells on the driver if they take up to limit bytes there."""
        if self.cells.count() * 16 <= limit:
            got = self.cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "w").toArrow()
            self.local = tuple(got.column(j).to_numpy() for j in range(3))
        return self

    def _times(self, x: np.ndarray, out: str, by: str) -> np.ndarray:
        if self.classes is not None:
            x = np.add.reduceat(x[self.order], self.starts, axis=0)
        if x.nbytes > LOCAL_BYTES:
            raise ValueError("the dense side exceeds LOCAL_BYTES; use the distributed operators (spmm)")
        y = np.zeros_like(x, dtype=float)
        if self.local is not None:
            r, c, w = self.local
            if len(w):
                at, rows = _row_sums()(*((r, c) if out == "r" else (c, r)), w, x)
                y[at] = rows
        else:
            self._distributed(x, y, out, by)
        return y if self.classes is None else y[self.classes]

    def _distributed(self, x: np.ndarray, y: np.ndarray, out: str, by: str) -> None:
        if out == "c" and self.by_column is None:
            self.by_column = self.cells.repartition("c").sortWithinPartitions("c").cache()
        shared = self.spark.sparkContext.broadcast(x)
        got = self._products(self.cells if out == "r" else self.by_column, shared, out, by).toArrow()
        if got.num_rows:
            rows = np.frombuffer(b"".join(got.column("y").to_pylist()), float).reshape(got.num_rows, -1)
            np.add.at(y, got.column("i").to_numpy(), rows)
        shared.destroy()

    @staticmethod
    def _products(cells: DataFrame, shared: Broadcast, out: str, by: str) -> DataFrame:
        """(i, y): sums of the cells' rows or columns as bytes, in parts where an Arrow batch ends inside one."""
        sums = _row_sums()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dense = shared.value
            for b in batches:
                at, of, w = (b.column(j).to_numpy(zero_copy_only=False) for j in range(3))
                if len(at):
                    rows, z = sums(at, of, w, dense)
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([r.tobytes() for r in z], pa.binary())], names=["i", "y"])

        return cells.select(out, by, "w").mapInArrow(run, "i long, y binary")

    def dot_rows(self, x: np.ndarray) -> tuple[DataFrame, Broadcast]:
        """dot as (entity_id, v) rows that stay in Spark, and the broadcast to destroy when they are written; without classes only."""
        shared = self.spark.sparkContext.broadcast(np.ascontiguousarray(x, float))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat = np.frombuffer(b"".join(b.column(1).to_pylist()), float)
                if len(flat):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (len(flat) // b.num_rows), pa.int32()), pa.array(flat))], names=["i", "v"])

        rows = self._products(self.cells, shared, "r", "c").mapInArrow(read, "i long, v array<double>")
        rows = rows.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select("i", vector_to_array("s").alias("v"))
        zeros = F.array_repeat(F.lit(0.0), x.shape[1])
        return self.index.join(rows, "i", "left").select(F.col("e").alias("entity_id"), F.coalesce("v", zeros).alias("v")), shared

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(np.ascontiguousarray(x, float), "r", "c")

    def t_dot(self, x: np.ndarray) -> np.ndarray:
        return self._times(np.ascontiguousarray(x, float), "c", "r")

    def close(self) -> None:
        self.cells.unpersist()
        if self.by_column is not None:
            self.by_column.unpersist()


def randomized_svd(dot, t_dot, n: int, k: int, seed: int = 0, power: int = 2, over: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U, S, V) of rank k of an n x n operator, from products with tall matrices only."""
    k = max(1, min(k, n))
    q = np.random.default_rng(seed).standard_normal((n, min(n, k + over)))
    for _ in range(power + 1):
        q, _ = np.linalg.qr(dot(q))
        z, _ = np.linalg.qr(t_dot(q))
        q, _ = np.linalg.qr(dot(z))
    u, s, vt = np.linalg.svd(t_dot(q).T, full_matrices=False)
    u = q @ u
    sign = np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return (u * sign)[:, :k], s[:k], (vt.T * sign)[:, :k]


def local_l2(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)


def to_emb(spark, ids: list[str], x: np.ndarray) -> DataFrame:
    table = pa.table({"entity_id": pa.array(ids, pa.string()), "v": pa.array(list(np.asarray(x, float)), pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def to_local(emb: DataFrame) -> tuple[list[str], np.ndarray]:
    """(ids, matrix) sorted by id; refused beyond LOCAL_BYTES."""
    emb = emb.persist()
    size = emb.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, d = size[0], size[1] or 0
    if n * d * 8 > LOCAL_BYTES:
        emb.unpersist()
        raise ValueError("the embedding exceeds LOCAL_BYTES")
    rows = emb.orderBy("entity_id").toArrow()
    emb.unpersist()
    return rows.column("entity_id").to_pylist(), _matrix(rows.column("v").combine_chunks()).reshape(n, d)
