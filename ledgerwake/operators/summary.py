"""Summary of numeric columns with exact quartiles, and row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.functions.scalars import measure
from ledgerwake.operators.quantiles import exact_quantiles


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, stddev, min, quartiles, max."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        value = measure(df, c).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("stddev"),
                F.min(value).alias("minimum"),
                *[
                    F.lit(q).cast("double").alias(name)
                    for name, q in zip(("q25", "q50", "q75"), quartiles[c])
                ],
                F.max(value).alias("maximum"),
            )
        )
    return df.agg(F.array(*rows).alias("summary")).select(F.inline("summary"))


def quick_summary(df: DataFrame, *columns: str) -> DataFrame:
    """Spark's own summary; its quartiles are approximate but need only one pass."""
    return df.select(*columns).summary()


def row_counts(df: DataFrame, **stages: Column) -> DataFrame:
    """One row per stage with the number of rows that meet its condition, from one pass."""
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(name).alias("stage"), F.count_if(condition).alias("n_rows"))
                for name, condition in stages.items()
            ]
        ).alias("counts")
    )
    return counted.select(F.inline("counts"))
