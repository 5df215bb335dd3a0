"""Exact interpolated quantiles of many columns without collecting values.

The first pass finds bounds and, from a quantile sketch, a narrow bracket around each wanted
rank.  Each further pass counts exactly: rows in value bins between a known lower and upper
bound, at most `BINS` groups per open range, and keeps only the bin that holds the wanted
rank.  A bracket that turns out not to hold it is left for the side that does.  Bin edges are
values of the data, so every pass splits the remaining distinct values and the search ends at
a single value.  Wide ranges are cut by magnitude, so the number of passes stays small however
the values are spread.  A pass reads only the columns asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.functions.scalars import measure

# Two passes tell apart BINS * BINS evenly spaced values, more than amounts in cents need.
BINS = 16384
# The sketch is off by at most one rank in SKETCH; a bracket reaches twice that far.
SKETCH = 10_000
# Above every binary exponent of a double, so that magnitudes are positive numbers.
_EXPONENTS = 1100.0


@dataclass(frozen=True)
class _Range:
    """Rows of one column with low <= value <= high; `below` rows are smaller."""

    column: str
    low: float
    high: float
    below: int

    def bin_of(self, value: Column) -> Column:
        near = (self.low > 0 or self.high < 0) and 0.25 <= self.low / self.high <= 4
        low, high = (self.low, self.high) if near else map(_magnitude, (self.low, self.high))
        place = value if near else _magnitude_of(value)
        position = F.greatest(F.floor((place - F.lit(low)) / F.lit(high - low) * BINS), F.lit(0))
        return F.least(position, F.lit(BINS - 1).cast("bigint"))


def _magnitude(value: float) -> float:
    """Rises with the value, by one where its size doubles; zero for zero."""
    return math.copysign(math.log2(abs(value)) + _EXPONENTS, value) if value else 0.0


def _magnitude_of(value: Column) -> Column:
    return F.when(value == 0, 0.0).otherwise(
        F.signum(value) * (F.log2(F.abs(value)) + F.lit(_EXPONENTS))
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    gaps_only: bool = False,
) -> dict[str, list[float | None]]:
    """For each column the quantiles of its known, finite-ordered values.

    Null and NaN are left out.  A quantile between two ranks is interpolated linearly.
    A column without values gives None.  With `gaps_only` columns without a gap are left out.
    """
    if not columns:
        return {}
    values = df.select(*[measure(df, c).cast("double").alias(c) for c in columns])
    found, wanted, open_ranges = {}, {}, {}
    for column, bound in _bounds(values, columns, probabilities).items():
        rows, count, low, high, lowest, highest, brackets = bound
        if gaps_only and rows == count:
            continue
        wanted[column] = count
        near = {
            r: brackets[2 * n : 2 * n + 2]
            for n, p in enumerate(probabilities)
            for r in _ranks(p, count)
        }
        for rank in near:
            if rank < lowest:
                found[column, rank] = -math.inf
            elif rank >= count - highest:
                found[column, rank] = math.inf
            elif low == high:
                found[column, rank] = low
            else:
                first, last = near[rank]
                whole = _Range(column, low, high, lowest)
                open_ranges[whole, rank] = _within(first, low, high), _within(last, low, high)
    while open_ranges:
        open_ranges = _narrow(values, open_ranges, found)
    return {
        column: [_interpolate(column, p, wanted[column], found) for p in probabilities]
        for column in columns
        if column in wanted
    }


def _within(value, low, high):
    return min(max(value, low), high)


def _bounds(values, columns, probabilities):
    """Per column: rows, known values, smallest and greatest finite value, rows at either
    infinity, and below and above each probability a value from the sketch."""
    reach = 2 / SKETCH
    around = [x for p in probabilities for x in (max(p - reach, 0.0), min(p + reach, 1.0))]
    finite = {c: F.when(F.abs(F.col(f"`{c}`")) < math.inf, F.col(f"`{c}`")) for c in columns}
    aggregates = []
    for c in columns:
        plain = F.col(f"`{c}`")
        aggregates.append(
            F.struct(
                F.count(F.lit(1)).alias("rows"),
                F.count(plain).alias("n"),
                F.min(finite[c]).alias("low"),
                F.max(finite[c]).alias("high"),
                F.count(F.when(plain == -math.inf, 1)).alias("lowest"),
                F.count(F.when(plain == math.inf, 1)).alias("highest"),
                F.percentile_approx(plain, around, SKETCH).alias("brackets"),
            )
        )
    row = values.agg(F.array(*aggregates).alias("bounds")).first()
    return {c: tuple(b) for c, b in zip(columns, row["bounds"])}


def _narrow(values, open_ranges, found):
    """One pass over the open ranges; returns those still open.

    `open_ranges` maps each range and wanted rank to the bracket whose bins are counted.
    What lies in the range below or above the bracket is one bin each.
    """
    cuts = sorted(
        {(r, bracket) for (r, _), bracket in open_ranges.items()},
        key=lambda cut: (cut[0].column, cut[0].low, cut[1]),
    )
    hits = []
    for index, (r, (first, last)) in enumerate(cuts):
        value = F.col(f"`{r.column}`")
        inner = F.lit(0) if first == last else _Range(r.column, first, last, 0).bin_of(value)
        place = F.when(value < first, -1).when(value > last, BINS).otherwise(inner)
        hit = F.struct(
            F.lit(index).alias("cut"), place.cast("int").alias("bin"), value.alias("value")
        )
        hits.append(F.when(value.between(r.low, r.high), hit))
    counted = (
        values.select(F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .groupBy("hit.cut", "hit.bin")
        .agg(
            F.count("*").alias("n"),
            F.min("hit.value").alias("low"),
            F.max("hit.value").alias("high"),
        )
    )
    # At most BINS + 2 rows per cut, whatever the size of the data.
    bins = {}
    for row in counted.collect():
        bins.setdefault(row["cut"], []).append(row)
    still_open = {}
    for (r, rank), bracket in open_ranges.items():
        below = r.below
        for row in sorted(bins[cuts.index((r, bracket))], key=lambda b: b["bin"]):
            if rank < below + row["n"]:
                break
            below += row["n"]
        low, high = row["low"], row["high"]
        if low == high or rank == below:
            found[r.column, rank] = low
        elif rank == below + row["n"] - 1:
            found[r.column, rank] = high
        else:
            still_open[_Range(r.column, low, high, below), rank] = low, high
    return still_open


def _ranks(probability, count):
    if count == 0:
        return ()
    position = probability * (count - 1)
    return (math.floor(position), math.ceil(position))


def _interpolate(column, probability, count, found):
    if count == 0:
        return None
    lower, upper = _ranks(probability, count)
    position = probability * (count - 1)
    low, high = found[column, lower], found[column, upper]
    if low == high:
        return low
    return (upper - position) * low + (position - lower) * high
