"""Constraints of the stored tables as row checks with reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.fixed_values import (
    GENDERS,
    ID_LENGTH,
    RAW_DECIMAL,
    REASON_LENGTH,
    REPORT_DECIMAL,
)
from ledgerwake.functions.scalars import is_missing, measure

REQUIRED_FIELDS = ("transaction_id", "customer_id", "customer_location")


def complete(transactions: DataFrame) -> DataFrame:
    """Rows that have an id, a customer and a location."""
    return transactions.na.drop(subset=list(REQUIRED_FIELDS))


def not_null(df: DataFrame, *columns: str) -> dict[str, Column]:
    return {f"{c}_missing": is_missing(df, c) for c in columns}


def in_domain(column: str, allowed: Sequence[str]) -> dict[str, Column]:
    """A null passes, as in a SQL check constraint."""
    return {f"{column}_not_allowed": F.col(column).isNotNull() & ~F.col(column).isin(*allowed)}


def max_length(limit: int, *columns: str) -> dict[str, Column]:
    return {f"{c}_too_long": F.char_length(c) > limit for c in columns}


def fits(df: DataFrame, decimal_type: str, *columns: str) -> dict[str, Column]:
    """The value has room in the decimal type; null passes."""
    return {
        f"{c}_overflow": measure(df, c).isNotNull()
        & measure(df, c).try_cast(decimal_type).isNull()
        for c in columns
    }


def narrow(df: DataFrame, decimal_type: str, *columns: str) -> DataFrame:
    """Columns in the stored decimal type; what does not fit becomes null."""
    return df.withColumns({c: measure(df, c).try_cast(decimal_type) for c in columns})


def raw_transaction_checks(df: DataFrame) -> dict[str, Column]:
    return {
        **not_null(df, "transaction_id", "customer_id", "transaction_amount_inr", "event_time"),
        **in_domain("customer_gender", GENDERS),
        **max_length(1, "customer_gender"),
        **fits(df, RAW_DECIMAL, "customer_account_balance", "transaction_amount_inr"),
    }


def alert_checks(df: DataFrame) -> dict[str, Column]:
    return {
        **not_null(
            df, "customer_id", "transaction_id", "amount", "anomaly_reason", "current_balance"
        ),
        **max_length(ID_LENGTH, "customer_id", "transaction_id", "location"),
        **max_length(REASON_LENGTH, "anomaly_reason"),
        **fits(df, REPORT_DECIMAL, "amount", "current_balance"),
    }


def measure_checks(df: DataFrame) -> dict[str, Column]:
    """What a windowed profile needs: a time and both measures."""
    return not_null(
        df, "customer_id", "event_time", "transaction_amount_inr", "customer_account_balance"
    )


def tag(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds `reject_reasons`, an array that is empty for a valid row."""
    found = F.array(*[F.when(failed, name) for name, failed in checks.items()])
    return df.withColumn("reject_reasons", F.array_compact(found))


def split(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows in their old shape, and rejected rows with reasons."""
    tagged = tag(df, checks)
    valid = tagged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return valid, tagged.filter(F.size("reject_reasons") > 0)


def reject_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """How many rows break each check; a row can break several."""
    return (
        tag(df, checks)
        .select(F.explode("reject_reasons").alias("reject_reason"))
        .groupBy("reject_reason")
        .agg(F.count("*").alias("n"))
    )


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Fails before any job starts when a column is not there."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a target table, picked by name and cast to its types.

    NaN is stored as null.  A value that the type has no room for ends the job instead of
    becoming null: `split` with `fits` sets such rows aside before.
    """
    require_columns(df, *schema.names)
    columns = []
    for f in schema:
        value = measure(df, f.name)
        stored = value.try_cast(f.dataType)
        lost = value.isNotNull() & stored.isNull()
        problem = F.raise_error(F.lit(f"{f.name}: a value does not fit {f.dataType.simpleString()}"))
        columns.append(F.when(lost, problem.cast(f.dataType)).otherwise(stored).alias(f.name))
    return df.select(*columns)


def keyed_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, of which none may lack a key; one that does ends the job."""
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    problem = F.raise_error(F.lit(f"a row lacks its key {', '.join(keys)}")).cast("boolean")
    return df.filter(F.when(absent, problem).otherwise(F.lit(True)))
