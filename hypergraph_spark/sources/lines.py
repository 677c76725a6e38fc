"""Hyperedge sources: text lines, files, tables, matrices. All give a DataFrame of (a ARRAY<STRING>, b ARRAY<STRING>)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.plans.spec import parse_spec, single_relation

#: What a line's trim removes: Unicode white space.
_TRIM = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"


def parse_line(line: Col) -> Col:
    """ARRAY<ARRAY<STRING>> of a line: cells by TAB, else by comma (cells trimmed), else one; tokens by one space.

    Double spaces give empty tokens.
    """
    text = F.regexp_replace(line, _TRIM, "")
    by_tab = F.transform(F.split(text, "\t", -1), lambda c: F.split(c, " ", -1))
    by_comma = F.transform(F.split(text, ",", -1), lambda c: F.split(F.regexp_replace(c, _TRIM, ""), " ", -1))
    return F.when(F.instr(text, "\t") > 0, by_tab).when(F.instr(text, ",") > 0, by_comma).otherwise(F.array(F.split(text, " ", -1)))


def hyperedges(lines: DataFrame, columns: str, line_col: str = "value") -> DataFrame:
    """(a, b) of the lines whose cell count fits the spec; others are skipped. Plain columns keep their first token."""
    spec = parse_spec(columns)
    i, j = single_relation(spec)
    cells = lines.select(parse_line(F.col(line_col)).alias("cells")).where(F.size("cells") == len(spec))
    side = lambda k: F.col("cells")[k] if spec[k].complex else F.slice(F.col("cells")[k], 1, 1)
    return cells.select(side(i).alias("a"), side(j).alias("b"))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of .tsv, .csv or .txt files, empty ones skipped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("Cannot find any input file path!")
    for p in paths:
        if not p.endswith((".tsv", ".csv", ".txt")):
            raise ValueError(f"only .tsv, .csv and .txt files can be read: {p}")
    return spark.read.text(paths).where(F.length("value") > 0)


def read_edge_file(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines of a file without blank lines and `#` comments."""
    lines = spark.read.text(path).select(F.regexp_replace("value", _TRIM, "").alias("value"))
    return lines.where((F.length("value") > 0) & ~F.col("value").startswith("#"))


def from_iterator(spark: SparkSession, lines: Iterable[str], columns: str) -> DataFrame:
    """Hyperedges of an iterator of strings; empty strings count as lines."""
    rows = list(lines)
    if any(not isinstance(x, str) for x in rows):
        raise TypeError("hyperedges must be strings")
    return hyperedges(spark.createDataFrame([(x,) for x in rows], "value string"), columns)


def from_table(df: DataFrame, source: str, target: str, weight: str | None = None) -> DataFrame:
    """`source target` lines of a table; rows with a null end, or with a null or zero weight, are dropped."""
    for c in (source, target, *([weight] if weight else [])):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    df = df.dropna(subset=[source, target])
    if weight:
        df = df.where(F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")) & (F.col(weight) != 0))
    return df.select(F.concat_ws(" ", F.col(source).cast("string"), F.col(target).cast("string")).alias("value"))


def from_edge_list(spark: SparkSession, edges: Iterable[Sequence]) -> DataFrame:
    """Lines of 2- or 3-tuples (the weight is ignored)."""
    rows = []
    for e in edges:
        if len(e) not in (2, 3):
            raise ValueError("an edge is (source, target) or (source, target, weight)")
        rows.append((f"{e[0]} {e[1]}",))
    return spark.createDataFrame(rows, "value string")


def from_networkx(spark: SparkSession, graph) -> DataFrame:
    """Lines of a networkx graph, or of anything with edges() of (source, target) or (source, target, data) tuples."""
    return from_edge_list(spark, [tuple(e)[:2] for e in graph.edges()])


def from_coo(cells: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Lines of the undirected, distinct non-zero cells (row, col, value) of a square matrix; self-loops are kept.

    ids (idx, entity_id) name the rows; by default a row's number is its name.
    """
    pairs = cells.where(F.col("value") != 0).select(F.least("row", "col").alias("i"), F.greatest("row", "col").alias("j")).distinct()
    if ids is None:
        return pairs.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string")).alias("value"))
    left = ids.select(F.col("idx").alias("i"), F.col("entity_id").alias("x"))
    right = ids.select(F.col("idx").alias("j"), F.col("entity_id").alias("y"))
    return pairs.join(left, "i").join(right, "j").select(F.concat_ws(" ", "x", "y").alias("value"))


def from_numpy(spark: SparkSession, matrix, entity_ids: Sequence[str] | None = None) -> DataFrame:
    """Lines of a square adjacency matrix; an edge if either cell of a pair is non-zero."""
    import numpy as np

    m = np.asarray(matrix)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError("adjacency matrix must be square")
    if entity_ids is not None and len(entity_ids) != len(m):
        raise ValueError("one entity id a row is needed")
    r, c = np.nonzero(m)
    cells = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(r, c, strict=True)], "row long, col long, value double")
    ids = spark.createDataFrame([(i, str(e)) for i, e in enumerate(entity_ids)], "idx long, entity_id string") if entity_ids is not None else None
    return from_coo(cells, ids)


def update_lines(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new lines together."""
    return existing.select("value").unionByName(new.select("value"))


def remove_lines(existing: DataFrame, gone: DataFrame) -> DataFrame:
    """Lines that equal none of the removed ones."""
    return existing.join(gone.select("value").distinct(), "value", "left_anti")


def tsv_rows(lines: DataFrame, columns: str, line_col: str = "value") -> DataFrame:
    """ARRAY<ARRAY<STRING>> cells of lines (legacy mode): columns apart by tabs, the tokens of complex ones by spaces."""
    spec = parse_spec(columns, legacy=True)
    cols = F.split(line_col, "\t", -1)
    cells = [F.split(F.col("c")[k], " ", -1) if c.complex else F.array(F.col("c")[k]) for k, c in enumerate(spec)]
    return lines.select(cols.alias("c")).where(F.size("c") == len(spec)).select(F.array(*cells).alias("cells"))


def json_rows(spark: SparkSession, path_or_lines: str | DataFrame, columns: str) -> DataFrame:
    """ARRAY<ARRAY<STRING>> cells of JSON lines by column name (legacy mode): complex columns are arrays, scalars become text."""
    spec = parse_spec(columns, legacy=True)
    lines = spark.read.text(path_or_lines) if isinstance(path_or_lines, str) else path_or_lines
    parsed = lines.select(F.from_json("value", "map<string,string>").alias("m"))
    cell = lambda c: F.transform(F.from_json(F.col("m")[c.name], "array<string>"), lambda x: x) if c.complex else F.array(F.col("m")[c.name])
    return parsed.select(F.array(*[cell(c) for c in spec]).alias("cells"))
