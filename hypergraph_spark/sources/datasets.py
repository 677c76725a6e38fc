"""Named datasets: synthetic stand-ins by size, and edge lists read from local files (nothing is downloaded)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.sources.generators import community_graph

# Nodes, edges, classes and seed of each synthetic dataset.
SYNTHETIC = {
    "cora": (2708, 5429, 7, 42),
    "citeseer": (3312, 4732, 6, 42),
    "pubmed": (19717, 44338, 3, 42),
    "amazon_computers": (13752, 245861, 10, 100),
    "amazon_photo": (7650, 119081, 8, 200),
    "ppi": (3890, 76584, 50, 300),
    "reddit": (10000, 100000, 41, 42),
    "dblp": (4057, 14328, 4, 42),
    "ogbn_arxiv": (169343, 1166243, 40, 42),
    "flickr": (89250, 899756, 7, 42),
    "ppi_large": (56944, 818716, 121, 42),
    "yelp": (716847, 6977410, 100, 42),
}
#: Datasets that are files: edge lists whose first two columns are the ends, read from the given path.
FILES = ("facebook", "roadnet", "livejournal", "com_orkut", "com_friendster", "reddit_hyperlink", "ogbn_products", "ogbl_citation2", "twitter", "karate_club", "dolphins", "les_miserables", "football")


#: Of these the columns are not apart by white space: separator, and how a header line starts.
FORMATS = {"reddit_hyperlink": ("\t", "SOURCE_SUBREDDIT"), "ogbn_products": (",", None), "ogbl_citation2": (",", None)}


def list_datasets() -> list[str]:
    return sorted([*SYNTHETIC, *FILES])


def read_edge_list(spark: SparkSession, path: str, sep: str = r"\s+", header: str | None = None) -> DataFrame:
    """(src, dst) of a text file (gz too): the first two columns, apart by sep; `#` lines and lines starting with header are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    if header:
        lines = lines.where(~F.col("value").startswith(header))
    parts = lines.select(F.split(F.btrim("value", F.lit(" \t\r")), sep).alias("p"))
    return parts.where(F.size("p") >= 2).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, label) of a file with one label a line, for the entities 0, 1, .. in the order of lines."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("i", "label"))
    return rows.select(F.col("i").cast("string").alias("entity_id"), F.btrim("label").cast("int").alias("label"))


def load_dataset(spark: SparkSession, name: str, path: str | None = None, labels: str | None = None) -> dict:
    """edges, labels (of synthetic sets, or read from the file `labels`) and columns of a dataset; file sets need the path of a local copy."""
    if name in SYNTHETIC:
        n, m, k, seed = SYNTHETIC[name]
        intra = 0.65 if name.startswith("amazon") else 0.6 if n > 50_000 else 0.7
        return {"name": name, "num_edges": m} | community_graph(spark, n, m, k, intra, seed, feature_dim=max(k, 32) if name in ("cora", "citeseer", "pubmed") else 0)
    if name in FILES:
        if path is None:
            raise ValueError(f"{name} is read from a file: pass its path")
        out = {"name": name, "edges": read_edge_list(spark, path, *FORMATS.get(name, (r"\s+", None))), "columns": "complex::reflexive::node"}
        return out | ({"labels": read_labels(spark, labels)} if labels else {})
    raise ValueError(f"unknown dataset {name!r}")
