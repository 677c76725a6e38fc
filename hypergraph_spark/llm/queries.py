"""The corpus operators' registered queries and, where SQL can state their results, the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.llm.decontaminate import find_contaminated
from hypergraph_spark.llm.fingerprints import version_fingerprints
from hypergraph_spark.llm.html import extract_text
from hypergraph_spark.llm.lines import dedup_lines
from hypergraph_spark.llm.mixing import CURRICULUM, curriculum_mix
from hypergraph_spark.llm.sharding import shard_documents
from hypergraph_spark.llm.simhash import simhash_components
from hypergraph_spark.llm.suffix import drop_repeats
from hypergraph_spark.llm.toxicity import score_toxicity
from hypergraph_spark.llm.urls import filter_urls, parse_rule

RULES = [
    parse_rule("block", "com/en/"),
    parse_rule("allow", "example.com/en/7"),
    parse_rule("allow", "net/de/"),
    parse_rule("block", "example.net/de/8"),
    parse_rule("block", "org/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(_table(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = version_fingerprints(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_documents(docs, shards=8, grown=9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), threshold=0.8, k=5)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op10_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum_mix(_table(spark, sf_dir, "documents"), schedules=CURRICULUM, keep=("doc_id",))
    # Times as millionths of the whole training, null where a document is not taken, or not again.
    at = lambda k: F.floor(F.get("positions", F.lit(k)) * 1_000_000).cast("long")
    return out.select("doc_id", "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("next_position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_document_fingerprints,
        op3_jump_sharding,
        op4_toxicity,
        op5_suffix_dedup,
        op6_url_filters,
        op7_line_dedup,
        op8_benchmark_decontamination,
        op9_html_extraction,
        op10_curriculum_mixing,
    )
}

_URL_PARTS = r"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p),
u AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM q),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
fits AS (SELECT u.page_id, r.verdict, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost) + length(r.rpath) DESC, length(r.rhost) DESC) AS rn
         FROM u JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN fits f ON f.page_id = u.page_id AND f.rn = 1
"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": _URL_PARTS.format(rules=", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)),
    "op7_line_dedup": f"""
WITH l AS (SELECT doc_id, line, i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, {_SPACES}), {_UPPER}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, c.keep IS NOT NULL AND c.keep <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op8_benchmark_decontamination": r"""
WITH bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bs),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT ds.doc_id, bs.item_id, count(*) AS shared FROM bs JOIN ds ON ds.n = bs.n AND ds.s = bs.s GROUP BY 1, 2),
total AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, shared::INTEGER AS shared, shared / n::DOUBLE AS containment
FROM hits JOIN total USING (item_id) WHERE shared >= 0.8 * n - 1e-9
""",
    "op10_curriculum_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS room FROM s),
o AS (SELECT *, coalesce(sum(room) OVER (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
      sum(weight) OVER (ORDER BY room / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - filled) / open_weight AS level FROM o),
f AS (SELECT level FROM l WHERE level * weight <= room ORDER BY room / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN (SELECT level FROM f) IS NULL OR (SELECT level FROM f) * weight > room THEN room ELSE (SELECT level FROM f) * weight END AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS mid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN mid < target THEN mid / target END AS s0, CASE WHEN mid + source_size < target THEN (mid + source_size) / target END AS s1 FROM m)
SELECT doc_id, size::BIGINT AS size, source_size, target, (greatest(0, ceil((target - mid) / greatest(source_size, 1))) * size)::BIGINT AS taken,
       floor(CASE WHEN s0 IS NULL THEN NULL WHEN rank % 3 = 0 THEN least(1.0::DOUBLE, 2 * s0 / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * s0, 0)))) WHEN rank % 3 = 1 THEN s0 ELSE least(1.0::DOUBLE, 2 * s0 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * s0))) END * 1000000)::BIGINT AS position,
       floor(CASE WHEN s1 IS NULL THEN NULL WHEN rank % 3 = 0 THEN least(1.0::DOUBLE, 2 * s1 / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * s1, 0)))) WHEN rank % 3 = 1 THEN s1 ELSE least(1.0::DOUBLE, 2 * s1 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * s1))) END * 1000000)::BIGINT AS next_position
FROM p
""",
}
