"""A corpus pipeline of five stages over `documents`; each stage is one operator of hypergraph_spark.llm.

Every stage takes nulls in any column (a null text as empty, a null doc_id after all others), repeated rows (each judged
and kept by itself, but for near_dedup, where rows equal in id and text are one), an empty table (an empty result) and
extra columns of any name, which all stages but the last return as they were; see the operators for ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import materialize
from hypergraph_spark.llm.decontaminate import decontaminate
from hypergraph_spark.llm.mixing import CURRICULUM, training_rows
from hypergraph_spark.llm.sharding import shard_documents
from hypergraph_spark.llm.simhash import drop_near_duplicates
from hypergraph_spark.llm.toxicity import drop_toxic, fit_toxicity, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model is fitted on the labels of ids that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    return drop_toxic(docs, model, least=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): the smallest doc_id."""
    return drop_near_duplicates(docs, k=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 of its five-word shingles)."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8, k=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that the mix takes a document, in training order."""
    return training_rows(docs, schedules=CURRICULUM)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes plus 1), shard (jump hash of doc_id among 8) and slot of every row."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return shard_documents(docs.select("doc_id", "source", size.alias("size")), shards=8).select("doc_id", "source", "size", "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL: the classifier, passage SimHash and jump hashing have none; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
