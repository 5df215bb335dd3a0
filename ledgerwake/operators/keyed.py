"""Key semantics: first write wins, last write wins, duplicates.

Each of these groups by key with an aggregate that combines before the shuffle,
so a key that holds a large share of the rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The earliest row of each key; equal rows in the order are told apart by the rest."""
    return _pick(df, keys, order_by, F.min)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, order_by, F.max)


def _pick(df, keys, order_by, choose):
    lead = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    if not lead + rest:
        return df.dropDuplicates(list(keys))
    return (
        df.groupBy(*keys)
        .agg(choose(F.struct(*lead, *rest)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def insert_ignore(
    existing_keys: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Rows of the batch that an insert with `on conflict do nothing` would add.

    The semi join keeps, of a large key set, only keys the batch also has.  When the
    batch is small Spark broadcasts it and the large side is scanned in place.
    Rows without a key cannot be stored; check them before with `validate.split`.
    """
    candidates = first_per_key(batch.na.drop(subset=list(keys)), keys, order_by)
    seen = existing_keys.select(*keys).join(
        candidates.select(*keys), list(keys), "left_semi"
    )
    return candidates.join(seen, list(keys), "left_anti")


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Target after the batch replaced every matching row and added the others."""
    updates = latest_per_key(batch.na.drop(subset=list(keys)), keys, order_by)
    kept = target.join(updates.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(updates.select(*target.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def duplicate_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that repeat and rows beyond the first of each."""
    return duplicate_keys(df, keys).agg(
        F.count("*").alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
    )
