"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

The documents of a source stand in a shuffled order and may be dealt out `repeats` times.
A copy's virtual finish time is the words of its source up to and including it, divided by
the weight of the source.  All copies in order of that time, cut off where the words reach
the budget, are the mix: while every source has copies left, the words taken are in
proportion to the weights, and a source that has run out leaves its share to the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import WORD, staged

# Bins of one narrowing pass, and copies that are few enough to be sorted at once.
BINS = 1024
SORTED_AT_ONCE = 4096


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sized: DataFrame, cycle: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """source, weight: the cycle dealt to the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return (
        sized.groupBy("source")
        .agg(F.lit(1))
        .select(
            "source",
            F.array(*map(F.lit, map(float, cycle)))[(place - 1) % len(cycle)].alias("weight"),
        )
    )


def mix(sized: DataFrame, weights: DataFrame, repeats: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row.

    `sized` has doc_id, source and size (words, not null); `weights` has source and weight
    (above 0).  The budget is the sum of all sizes.  `copies` says how often the mix holds
    the row, `taken` is copies times size.

    Rows without words get copies by the same clock and add nothing.  Rows that repeat an
    id count as further documents.  Rows whose source has no weight are left out.  Null is
    a source like any other.  An empty table gives an empty result.

    Running sums are taken in two levels, within ranges of the shuffled order and over the
    totals of the ranges; there are about as many ranges as rows in a range, so a source
    that holds most rows is spread over many tasks.
    """
    # A key that sorts null last and joins with plain equality.
    key = F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), "source"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "doc_id"), 1)
    rows = staged(
        sized.select("doc_id", "source", "size", key.alias("key"), place.alias("place")), "sizes"
    )
    ranges = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("span", F.floor(F.col("place") / F.lit(2.0**63) * ranges))
    spans = staged(rows.groupBy("key", "span").agg(F.sum("size").alias("words")), "spans")
    sources = _targets(spans, weights.select(key.alias("key"), "weight"), repeats)
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spans = spans.join(sources, "key").select(
        "key",
        "span",
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"),
        "source_size",
        "weight",
        "target",
    )
    within = (
        Window.partitionBy("key", "span")
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    queued = staged(
        rows.join(spans, ["key", "span"]).select(
            "doc_id",
            "source",
            "size",
            "place",
            "source_size",
            "target",
            "weight",
            (F.col("before") + F.sum("size").over(within)).alias("upto"),
        ),
        "queue",
    )
    last = _cutoff(queued, repeats)
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", _copies(last, repeats).alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def _targets(spans: DataFrame, weights: DataFrame, repeats: int) -> DataFrame:
    """key, source_size, weight, target: shares by weight, none above `repeats` times its source.

    In the order in which the sources run out, let all before one have run out: the clock at
    which the rest use up the budget is the mix's end if that one lasts so long.  For later
    ones the clock would be earlier, so the latest such clock is the end.
    """
    totals = spans.groupBy("key").agg(F.sum("words").alias("source_size")).join(weights, "key")
    totals = totals.withColumn("ends", repeats * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ends", "key")
    out = F.sum(repeats * F.col("source_size")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole)
    clock = totals.withColumn("clock", (budget - F.coalesce(out, F.lit(0))) / left)
    holds = F.when(F.col("clock") <= F.col("ends"), F.col("clock"))
    return clock.withColumn("stop", F.max(holds).over(whole)).select(
        "key",
        "source_size",
        "weight",
        F.least(
            F.col("weight") * F.col("stop"), repeats * F.col("source_size").cast("double")
        ).alias("target"),
    )


def _finish(lap: Column) -> Column:
    return (lap * F.col("source_size") + F.col("upto")) / F.col("weight")


def _copies(last: tuple[float, int], repeats: int) -> Column:
    """How many copies of a row come no later than `last`, a finish time and a place."""
    time, place = last
    counted = F.lit(0)
    for lap in range(repeats):
        finish = _finish(F.lit(lap))
        taken = (finish < time) | ((finish == time) & (F.col("place") <= place))
        counted = counted + F.when(taken, 1).otherwise(0)
    return counted.cast("long")


def _cutoff(queued: DataFrame, repeats: int) -> tuple[float, int]:
    """Finish time and place of the last copy that the budget allows.

    Copies are counted in ranges of finish time; the range in which the budget ends is
    narrowed pass by pass until it is short enough to be sorted.  A pass hands the driver
    one row per range.
    """
    copies = queued.filter("size > 0").select(
        "size", "place", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("lap"),
        "source_size", "upto", "weight",
    )
    copies = copies.select("size", "place", _finish(F.col("lap")).alias("finish"))
    budget = queued.agg(F.sum("size")).first()[0]
    low, high, count = copies.agg(F.min("finish"), F.max("finish"), F.count(F.lit(1))).first()
    if not count:
        return (math.inf, 0)
    before = 0
    while count > SORTED_AT_ONCE and low < high:
        width = (high - low) / BINS
        inside = copies.filter(F.col("finish").between(low, high))
        bin_of = F.least(F.floor((F.col("finish") - low) / width), F.lit(BINS - 1))
        found = (
            inside.groupBy(bin_of.alias("bin"))
            .agg(
                F.sum("size").alias("words"),
                F.count(F.lit(1)).alias("copies"),
                F.min("finish").alias("low"),
                F.max("finish").alias("high"),
            )
            .orderBy("bin")
            .collect()
        )
        for one in found:
            if before + one.words > budget or one is found[-1]:
                break
            before += one.words
        if one.copies == count and (one.low, one.high) == (low, high):
            break
        low, high, count = one.low, one.high, one.copies
    order = Window.orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        copies.filter(F.col("finish").between(low, high))
        .select("finish", "place", (F.sum("size").over(order) + before).alias("words"))
        .filter(F.col("words") <= budget)
        .agg(F.max(F.struct("finish", "place")).alias("last"))
        .first()
        .last
    )
    return (last.finish, last.place) if last else (low, -1)


def mix_words(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The mix of documents by number of words, with weights dealt in a cycle."""
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "words")
    return mix(sized, cyclic_weights(sized, cycle))


def deal(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The mix itself: each row of `docs`, with all its columns, as often as the mix holds it.

    Rows that repeat id, source and size are dealt as often as the one dealt most often.
    """
    copies = (
        mix_words(docs, cycle)
        .groupBy("doc_id", "source", "size")
        .agg(F.max("copies").alias("_copies"))
        .filter("_copies > 0")
        .toDF("_doc_id", "_source", "_size", "_copies")
    )
    same = (
        docs["doc_id"].eqNullSafe(copies["_doc_id"])
        & docs["source"].eqNullSafe(copies["_source"])
        & (words(docs["text"]) == copies["_size"])
    )
    repeated = F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")
    return docs.join(copies, same).select(*[docs[c] for c in docs.columns], repeated).drop("_copy")
