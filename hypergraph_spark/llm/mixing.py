"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import hidden, materialize, word_count

#: A schedule: knots (time 0 to 1, factor >= 0) of a piecewise linear factor on a source's weight.
Schedule = Sequence[tuple[float, float]]
FLAT: Schedule = ((0.0, 1.0), (1.0, 1.0))
#: The production curriculum, dealt to sources in turn as the weights are: heavy sources fade, middle ones stay, light ones grow.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), FLAT, ((0.0, 0.5), (1.0, 1.5)))
#: Offsets of up to so many (source, bucket) pairs, some 10 MB, are broadcast.
BROADCAST_ROWS = 200_000
MADE = ("size", "source_size", "target", "copies", "taken", "positions")


def _pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, f0, f1, share of the integral before t0), the integral over 0 to 1 scaled to 1."""
    knots = sorted(schedule)
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or min(f for _, f in knots) < 0:
        raise ValueError("a schedule runs from time 0 to 1 with factors >= 0")
    parts = [(a[0], b[0], a[1], b[1]) for a, b in zip(knots, knots[1:], strict=False) if b[0] > a[0]]
    area = sum((t1 - t0) * (f0 + f1) / 2 for t0, t1, f0, f1 in parts)
    if area <= 0:
        raise ValueError("a schedule has a positive integral")
    out, done = [], 0.0
    for t0, t1, f0, f1 in parts:
        out.append((t0, t1, f0 / area, f1 / area, done))
        done += (t1 - t0) * (f0 + f1) / 2 / area
    return out


def invert_demand(share: Column, schedule: Schedule) -> Column:
    """The time at which the schedule's integral has reached `share` (0 to 1) of its whole."""
    out = F.lit(1.0)
    for t0, t1, f0, f1, done in reversed(_pieces(schedule)):
        need, slope = share - F.lit(done), (f1 - f0) / (t1 - t0)
        # Root of f0 x + slope x^2 / 2 = need, in the form that is stable for slopes near 0.
        root = F.sqrt(F.greatest(F.lit(f0 * f0) + 2 * F.lit(slope) * need, F.lit(0.0)))
        x = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / F.greatest(F.lit(f0) + root, F.lit(1e-300)))
        end = done + (t1 - t0) * (f0 + f1) / 2
        out = F.when(share < F.lit(end), F.least(F.lit(t1), F.lit(t0) + x)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) with rank, weight and target.

    Sources in code point order, null last, take the weights in turn and share `total` of all sizes;
    targets stop at `cap` times the source's size, the excess reshared by weight. The water level is
    found in closed form: sources ordered by capacity per weight fill up one after the other.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(every) - 1).withColumn("weight", w).withColumn("room", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("__full", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("__open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("__level", (F.sum("source_size").over(whole) * F.lit(float(total)) - F.col("__full")) / F.col("__open"))
    # The first source in this order that does not fill up sets the level for all after it.
    level = F.min(F.when(F.col("__level") * F.col("weight") <= F.col("room"), F.struct(F.col("room") / F.col("weight"), "rank", "__level"))).over(whole)["__level"]
    target = F.when(level.isNull() | (level * F.col("weight") > F.col("room")), F.col("room")).otherwise(level * F.col("weight"))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def curriculum_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, schedules: dict[str, Schedule] | Sequence[Schedule] | None = None, buckets: int = 256, bucket_rows: int = 50_000, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, all if None), range-sorted by their first training position, with size, source_size, target, copies, taken, positions.

    Every document of a source is laid once on the source's token axis, in an order fixed by the md5 of its
    id and text; the axis repeats. The source's cumulative token demand at time t is its target times the integral of
    its schedule from 0 to t, scaled to 1 over the whole time; the k-th lap's copy is taken at the time at which that
    demand reaches the middle of its span - its position, 0 to 1 - and not at all if the demand never does. So a
    source misses its target by half a document at most and a document is taken ceil(cap) times at most. `schedules`
    are given by source, or as a sequence dealt to the sources in turn (CURRICULUM is one); flat where none is.
    Spans come from prefix sums in two levels - hash buckets within a source, then rows within a bucket - so a
    source with a third of all rows is never ordered in one task. There are `buckets` a source, or as many (65,536
    at most) as keep the largest source's at about bucket_rows rows; results do not depend on either. Null source is a source of its own; texts
    that are null or empty have size 0, span nothing and are taken as their place on the axis says, adding 0
    words. Repeated rows are ordered by their hash, ties by size. Reruns agree. An empty table gives an empty
    result. Extra columns stay; those named like the results are replaced. If the text is not kept, texts are read
    once, and what is moved has none.
    """
    inner, own = hidden(docs, ("doc_id", "text", "source"), MADE)
    shown = [c for c in (keep or own) if c not in MADE]
    mixed = _placed(inner, weights, total, cap, schedules, buckets, bucket_rows, [inner.columns[own.index(c)] for c in shown])
    return mixed.orderBy(F.element_at(F.concat("positions", F.array(F.lit(2.0))), 1), "doc_id").toDF(*shown, *MADE)


def training_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, schedules: dict[str, Schedule] | Sequence[Schedule] | None = None) -> DataFrame:
    """A row of docs for every time that the mix takes it (see curriculum_mix), range-sorted by that position, then doc_id.

    The columns are those of docs, source and text among them.
    """
    inner, names = hidden(docs, ("doc_id", "text", "source"))
    mixed = _placed(inner, weights, total, cap, schedules).withColumn("__position", F.explode("positions"))
    return mixed.orderBy("__position", "doc_id").select(*inner.columns).toDF(*names)


def _placed(docs: DataFrame, weights: Sequence[float], total: float, cap: float, schedules: dict[str, Schedule] | Sequence[Schedule] | None, buckets: int = 256, bucket_rows: int = 50_000, keep: Sequence[str] | None = None) -> DataFrame:
    names = list(keep or docs.columns)
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    df = docs.select(*dict.fromkeys([*names, "source"]), word_count(F.col("text")).alias("size"), order.alias("__order"))
    if "text" not in names:
        df = materialize(df, "mix-sizes")
    return place(df, names, weights, total, cap, schedules, buckets, bucket_rows)


def place(df: DataFrame, names: list[str], weights: Sequence[float], total: float, cap: float, schedules: dict[str, Schedule] | Sequence[Schedule] | None, buckets: int, bucket_rows: int) -> DataFrame:
    """curriculum_mix, unsorted, from rows that already hold size and __order (hex text)."""
    fine = F.conv(F.substring("__order", 1, 4), 16, 10).cast("long")
    # Counted at the finest split first, so that buckets can grow in number with the largest source.
    found = materialize(df.groupBy("source", fine.alias("__fine")).agg(F.sum("size").alias("__sum"), F.count(F.lit(1)).alias("__n")), "mix-sums")
    seen = found.groupBy("source").agg(F.sum("__n").alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    buckets = min(65536, max(buckets, -(-(seen["most"] or 0) // bucket_rows)))
    coarse = lambda c: F.floor(c * buckets / 65536).cast("int")
    df = df.withColumn("__bucket", coarse(fine))
    sums = found.groupBy("source", coarse(F.col("__fine")).alias("__bucket")).agg(F.sum("__sum").alias("__sum"))
    # One row per source and bucket, bounded before it is broadcast; where there are more, rows are joined by shuffle.
    send = F.broadcast if seen["sources"] * buckets <= BROADCAST_ROWS else (lambda x: x)
    targets = source_targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, total, cap)
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(F.col("o.source").alias("__source"), F.col("o.__bucket").alias("__b"), "__offset", "source_size", "target", F.col("rank").alias("__rank"))
    df = df.join(send(offsets), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    within = Window.partitionBy("source", "__bucket").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__mid", F.col("__offset") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2.0)

    def position(share: Column) -> Column:
        if isinstance(schedules, dict):
            out = invert_demand(share, FLAT)
            for name, schedule in schedules.items():
                out = F.when(F.col("source") == name, invert_demand(share, schedule)).otherwise(out)
            return out
        cycle = list(schedules or [FLAT])
        turn = F.pmod(F.col("__rank"), F.lit(len(cycle)))
        out = invert_demand(share, cycle[0])
        for i, schedule in enumerate(cycle[1:], 1):
            out = F.when(turn == i, invert_demand(share, schedule)).otherwise(out)
        return out

    # A lap's share of the whole demand; those below 1 have a time at which they are due.
    laps = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(cap))), lambda k: F.col("__mid") + k * F.col("source_size"))
    due = F.transform(F.filter(laps, lambda x: x < F.col("target")), lambda x: x / F.col("target"))
    df = df.withColumn("positions", F.transform(due, position))
    copies = F.size("positions")
    return df.select(*names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "positions")
