"""Column helpers shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)


def measure(df: DataFrame, name: str) -> Column:
    """Numeric column with NaN turned into null.

    Spark orders NaN above every number, so a rule such as `abs(x) > limit` would
    fire on it.  The column is named once only: it may stand for a long expression.
    """
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, FLOATS):
        return F.nanvl(column, F.lit(None).cast(kind))
    return column


def is_missing(df: DataFrame, name: str) -> Column:
    """True for null and, in floating-point columns, for NaN."""
    return measure(df, name).isNull()


def clock(run_ts: datetime | str | None) -> Column:
    """Time of the run: the given moment, else the current time."""
    if run_ts is None:
        return F.current_timestamp()
    return F.lit(run_ts).cast("timestamp")


def content_id(*columns: Column) -> Column:
    """Key that depends on content only, so a replayed row gets the same key.

    Each part carries a presence mark, so null and the empty string differ.
    """
    parts = [
        F.when(column.isNull(), "-").otherwise(F.concat(F.lit("+"), column.cast("string")))
        for column in columns
    ]
    return F.md5(F.concat_ws("|", *parts))


def packed_id(text: Column) -> Column:
    """An id as bytes, other bytes for each other id; one that ends in a `content_id` takes 15 bytes less.

    A last byte of 1 tells that the first 16 stand for 32 digits at the end of the text.
    """
    digest = F.right(text, F.lit(32))
    start = F.left(text, F.length(text) - 32).cast("binary")
    packed = F.concat(F.unhex(digest), start, F.lit(b"\x01"))
    whole = F.concat(text.cast("binary"), F.lit(b"\x00"))
    return F.when(digest.rlike(r"\A[0-9a-f]{32}\z"), packed).otherwise(whole)


def hash_share(key: Column, seed: str) -> Column:
    """Number in [0, 1) fixed by key and seed, the same on every partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
