"""Missing values: report, drop, and fill.

Fill values come from one bounded aggregate over all columns and enter the final
projection as literals, so filling adds no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.fixed_values import CSV_AMOUNT, CUSTOM_FILLS, WITHDRAWAL_SHARE
from ledgerwake.functions.scalars import hash_share, is_missing, measure
from ledgerwake.operators.modes import exact_modes
from ledgerwake.operators.quantiles import exact_quantiles
from ledgerwake.operators.validate import require_columns


def null_report(df: DataFrame) -> DataFrame:
    """Missing cells per column, all columns, counted in one pass."""
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count(F.when(is_missing(df, c), 1)).alias("missing"),
                )
                for c in df.columns
            ]
        ).alias("report")
    )
    return counts.select(F.inline("report"))


def with_gaps(report: DataFrame) -> DataFrame:
    """The columns of a report that miss something."""
    return report.filter(F.col("missing") > 0)


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def fill_mean(df: DataFrame) -> DataFrame:
    """Numeric columns that miss something get their mean; all others keep their type."""
    columns = numeric_columns(df)
    if not columns:
        return df
    found = df.agg(
        F.array(
            *[
                F.struct(
                    F.max(is_missing(df, c)).alias("gaps"),
                    F.avg(measure(df, c)).cast("double").alias("mean"),
                )
                for c in columns
            ]
        )
    ).first()[0]
    return fill(df, {c: one["mean"] for c, one in zip(columns, found) if one["gaps"]})


def fill_median(df: DataFrame) -> DataFrame:
    """Numeric columns that miss something get their median; all others keep their type."""
    medians = exact_quantiles(df, numeric_columns(df), [0.5], gaps_only=True)
    return fill(df, {c: m[0] for c, m in medians.items()})


def columns_with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that miss at least one cell, found in one pass."""
    if not columns:
        return []
    missing = df.agg(F.array(*[F.max(is_missing(df, c)) for c in columns])).first()[0]
    return [c for c, some in zip(columns, missing) if some]


def fill_mode(df: DataFrame) -> DataFrame:
    """Columns that miss something get their mode; only the values of these are counted."""
    columns = columns_with_gaps(df, df.columns)
    if not columns:
        return df
    modes = exact_modes(df.select(*[F.col(f"`{c}`") for c in columns]))
    return fill(df, dict(zip(columns, modes)))


def fill_custom(df: DataFrame, fills: Mapping[str, object] = CUSTOM_FILLS) -> DataFrame:
    """Given value per column; names the frame does not have are ignored."""
    return fill(df, {c: v for c, v in fills.items() if c in df.columns})


def column_modes(df: DataFrame) -> DataFrame:
    """One row with the most frequent value of every column; smallest on a tie."""
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return df.sparkSession.createDataFrame([tuple(exact_modes(df))], kinds)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Missing cells replaced; a None value leaves its column as it is.

    Whole-number columns take the type of the value when it is not whole, as a mean
    or a median need not be.
    """
    filled = {}
    for column, value in values.items():
        if value is None:
            continue
        kind = df.schema[column].dataType
        kept = measure(df, column)
        if isinstance(value, float) and isinstance(kind, (T.IntegralType, T.DecimalType)):
            filled[column] = F.coalesce(kept.cast("double"), F.lit(value))
        else:
            filled[column] = F.coalesce(kept, F.lit(value).cast(kind))
    return df.withColumns(filled)


STRATEGIES = {
    "report": lambda df: df,
    "drop": drop_missing,
    "fill_mean": fill_mean,
    "fill_median": fill_median,
    "fill_mode": fill_mode,
    "custom": fill_custom,
}


def clean(df: DataFrame, strategy: str = "report") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](df)


def sign_amounts(
    df: DataFrame,
    key: list[str],
    amount: str = CSV_AMOUNT,
    withdrawal_share: float = WITHDRAWAL_SHARE,
    seed: str = "sign",
) -> DataFrame:
    """Turns a share of the amounts into withdrawals and makes all others positive.

    Text that is no number becomes null.  The choice hangs on a digest of the key and
    the seed, so it does not change with the partitioning or on a retried task.
    """
    require_columns(df, amount, *key)
    number = measure(df, amount)
    if amount not in numeric_columns(df):
        number = number.try_cast("double")
    text = F.concat_ws(":", *[F.col(f"`{c}`").cast("string") for c in key])
    withdrawal = hash_share(text, seed) < F.lit(withdrawal_share)
    return df.withColumn(
        amount, F.when(withdrawal, -F.abs(number)).otherwise(F.abs(number))
    )
