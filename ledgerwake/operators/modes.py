"""Exact modes of many columns, by heavy hitters.

A sketch per column, of bounded size and merged across tasks, names a few candidates and
bounds how often any other value can occur.  The next pass counts, for a column whose best
candidate seems to be above that bound, the candidates alone, which proves the mode; flat
columns count all their values there, texts with many distinct ones as 64-bit hashes.  A text whose hash is alone at the
top is looked up in a last pass; only where several are, texts are counted themselves.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.functions.scalars import FLOATS, measure
from ledgerwake.session import work_folder

# Candidates of a column, and values that its sketch holds at a time.
CANDIDATES, TRACKED = 8, 6000
# The sketch keeps within 2.625 / TRACKED of all rows and names what is surely above that, so
# a value that is not named has at most twice that share.
UNNAMED = 2 * 2.625
# Moments are left to the hashes: as literals they are ambiguous when clocks are set back.
SKETCHED = (T.BooleanType, T.IntegralType, *FLOATS, T.DecimalType, T.DateType)
# Types that are no longer than a hash, or hardly, are counted as they are.
NARROW = (*SKETCHED, T.TimestampType, T.TimestampNTZType)
# Types whose cells are written down for all passes.
STORED = (*NARROW, T.StringType, T.BinaryType)
# Texts with about as many distinct ones, or fewer, are counted as they are as well.
FEW = 100_000
# Columns that share a pass; a grouping id has room for 63.
TOGETHER = 40


def exact_modes(df: DataFrame) -> list:
    """The most frequent value of every column; the smallest on a tie, None without values."""
    # Plain internal names, so that no column of the data can clash.
    cells = [f"cell_{i}" for i in range(len(df.columns))]
    known = df.select(*[_cell(df, c).alias(cell) for c, cell in zip(df.columns, cells)])
    if cells and all(isinstance(f.dataType, STORED) for f in known.schema):
        # Written down once: what the rows come from may cost more than all passes over them.
        spark, folder = df.sparkSession, work_folder(df.sparkSession, "cells")
        known.write.parquet(folder)
        known = spark.read.schema(known.schema).parquet(folder)
    found = {}
    for at in range(0, len(cells), TOGETHER):
        part = known.select(*cells[at : at + TOGETHER])
        named, few = candidates(part)
        proven = count(part, named, few)
        flat = [c for c in part.columns if c not in proven]
        found.update({**proven, **(count(part.select(*flat), {}, few) if flat else {})})
    return [found[c] for c in cells]


def _cell(df: DataFrame, name: str) -> Column:
    """NaN is missing, and the two zeros of floating point are one value."""
    value, kind = measure(df, name), df.schema[name].dataType
    if isinstance(kind, FLOATS):
        return F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)
    return value


def candidates(known: DataFrame) -> tuple[dict[str, tuple[list, float]], set[str]]:
    """Values of each column that may be its mode, and how often any other can occur at most.

    Columns are left out where the sketch can't prove a mode.  Beside them, the text columns
    with few distinct values.
    """
    columns = [
        f.name for f in known.schema
        if isinstance(f.dataType, SKETCHED) or f.dataType == T.StringType()
    ]
    if not columns:
        return {}, set()
    sketches = [
        F.struct(
            F.count(c).alias("n"),
            F.expr(
                f"approx_top_k({c}, {CANDIDATES}, {TRACKED}) FILTER (WHERE {c} IS NOT NULL)"
            ).alias("top"),
            F.approx_count_distinct(c).alias("distinct"),
        ).alias(c)
        for c in columns
    ]
    sketched, found = known.agg(*sketches).first(), {}
    few = {c for c in columns if sketched[c].distinct <= FEW}
    for c in columns:
        top = sketched[c].top or []
        unnamed = UNNAMED * sketched[c].n / TRACKED
        if len(top) == CANDIDATES:
            unnamed = max(unnamed, top[-1]["count"])  # the others were estimated no higher
        if top and top[0]["count"] > unnamed:
            found[c] = [one["item"] for one in top], unnamed
    return found, few


def count(
    known: DataFrame, named: dict[str, tuple[list, float]], few: Collection[str] = ()
) -> dict[str, object]:
    """Modes from one count of all columns; of `named` ones only where that proves them."""
    kinds = {f.name: f.dataType for f in known.schema}
    plain = {c for c, k in kinds.items() if c in named or c in few or isinstance(k, NARROW)}
    texts = [c for c in kinds if c not in plain]
    tops = top_counts(
        known.select(
            *[
                F.when(F.col(c).isin([F.lit(v).cast(kinds[c]) for v in named[c][0]]), F.col(c)).alias(c)
                if c in named
                else F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) if c in texts else F.col(c)
                for c in known.columns
            ]
        )
    )
    modes = {
        c: tops[c]["first"] for c in known.columns
        if c not in texts and (c not in named or (tops[c]["n"] or 0) > named[c][1])
    }
    return {**modes, **(_look_up(known.select(*texts), tops) if texts else {})}


def top_counts(cells: DataFrame) -> dict[str, Row]:
    """Of each column n, the highest count, and the first and the last value that has it.

    Values are counted with one grouping set per column, so a single scan feeds all counts.
    """
    names = cells.columns
    counts = cells.groupingSets([[c] for c in names], *names).agg(
        F.grouping_id().alias("set_id"), F.count("*").alias("n")
    )
    tops = []
    for position, c in enumerate(names):
        # In a grouping id the bit of the one grouped column is 0, all others are 1.
        own_set = (1 << len(names)) - 1 - (1 << (len(names) - 1 - position))
        # Rows of other sets are filtered before anything is made of them.
        counted = f"FILTER (WHERE set_id = {own_set} AND {c} IS NOT NULL)"
        tops.append(
            F.struct(
                F.expr(f"max(n) {counted}").alias("n"),
                F.expr(f"min_by({c}, struct(-n, {c})) {counted}").alias("first"),
                F.expr(f"max_by({c}, struct(n, {c})) {counted}").alias("last"),
            ).alias(c)
        )
    return counts.agg(*tops).first().asDict()


def _look_up(known: DataFrame, tops: dict[str, Row]) -> dict[str, object]:
    """Modes of columns whose hashes were counted."""
    lookups = []
    for c in known.columns:
        wanted = F.col(c)
        if tops[c]["n"] != 1:  # where no hash repeats, no value does, and the smallest is the mode
            wanted = F.when(F.xxhash64(c) == F.lit(tops[c]["first"]), wanted)
        lookups.append(F.struct(F.min(wanted).alias("low"), F.max(wanted).alias("high")).alias(c))
    found, modes = known.agg(*lookups).first(), {}
    for c in known.columns:
        n, alone = tops[c]["n"], tops[c]["first"] == tops[c]["last"]
        settled = n in (None, 1) or (alone and found[c].low == found[c].high)
        modes[c] = found[c].low if settled else most_frequent(known.select(c), n)
    return modes


def most_frequent(column: DataFrame, least: int) -> object:
    """The mode among values whose hash occurs `least` times or more.

    No value occurs more often than its hash, so one that reaches `least` settles it.  If none
    does, some share a hash, and all that could beat the best one are counted.
    """
    (name,) = column.columns
    hashed = column.na.drop().withColumn("hash", F.xxhash64(name))
    times = F.count(F.lit(1)).alias("times")
    frequent = hashed.groupBy("hash").agg(times).filter(F.col("times") >= least).select("hash")
    counted = hashed.join(frequent, "hash", "left_semi").groupBy(name).agg(times)
    best = counted.agg(
        F.min_by(name, F.struct(-F.col("times"), name)).alias("mode"), F.max("times").alias("n")
    ).first()
    return best["mode"] if best["n"] >= least else most_frequent(column, best["n"])
