"""Line dedup: lines found in many documents go, except in the last document that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import NULL_ID, ascii_lower, hidden, materialize, strip_ws


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(strip_ws(line))


def _digest(key: Column) -> Column:
    """128 bits of the key: two 64-bit hashes, so that chance equality stays out of reach at any size.

    A hash of several columns seeds each column's with the one before; the literal comes first, so that the second
    hash is the key's under another seed and not a function of the first.
    """
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with its text rewritten, and n_lines and n_dropped.

    A text is split at \\n (null or empty: one empty line). Keys (line_key) of at least min_chars code
    points found in at least min_docs distinct doc_ids lose all their lines except in the largest doc_id
    holding one. Rows that repeat a doc_id are one document for the counts and each is rewritten; a null
    doc_id is a document below all others. Lines are exploded with their positions, the lost positions found by a join
    on the key's hash, and texts reassembled from the positions that stay, in time linear in lines. A text of which every line goes becomes empty; a null text with
    no line dropped stays null. Extra columns are kept; those named n_lines or n_dropped are replaced.
    """
    docs, own = hidden(docs, ("doc_id", "text"), ("n_lines", "n_dropped"))
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    # A row's positions hold for every row of its id and text.
    base = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__th", F.xxhash64(text))
    exploded = base.where(F.length("text") >= min_chars).select("__id", "__th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = exploded.select("__id", "__th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select(_digest(F.col("key")).alias("h"), "__id", "__th", "pos")
    keyed = materialize(keyed, "line-keys")
    common = keyed.groupBy("h", "__id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("__keep"))
    common = materialize(common.where(F.col("n") >= min_docs), "line-common")
    # Lines that hold a thousandth of all are a thousand at most: they are broadcast, so that no task gathers their rows.
    heavy = F.col("n") * 1000 >= max(1, keyed.count())
    most, rest = F.broadcast(common.where(heavy).select("h", "__keep")), common.where(~heavy).select("h", "__keep")
    found = keyed.join(most, "h").unionByName(keyed.join(most.select("h"), "h", "left_anti").join(rest, "h"))
    lost = found.where(F.col("__id") != F.col("__keep")).groupBy("__id", "__th").agg(F.collect_set("pos").alias("__lost"))
    # Texts travel as their lines, so that each is split once and every line is then reached by its position.
    split = base.select(*[c for c in names if c != "text"], "__id", "__th", F.col("text").isNull().alias("__null"), F.split(text, "\n", -1).alias("__lines"))
    df = split.join(lost, ["__id", "__th"], "left")
    n = F.size("__lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("__lost", F.array().cast("array<int>")))
    # A line of its own position is taken from the array; `__lines` comes out of a join, so nothing is split again.
    kept = F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get("__lines", i)))
    made = F.when(~(F.col("__null") & F.col("__lost").isNull()), F.array_join(kept, "\n"))
    n_dropped = F.coalesce(F.size("__lost"), F.lit(0))
    return df.select(*[made.alias("text") if c == "text" else F.col(c) for c in names], n.cast("long").alias("n_lines"), F.when(F.col("__lost").isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped")).toDF(*own, "n_lines", "n_dropped")
