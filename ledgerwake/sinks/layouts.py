"""The stored tables with the partitions they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.schemas import ANOMALIES, PROFILES, RAW_TRANSACTIONS
from ledgerwake.sinks.tables import PARTS, InsertIgnoreTable, UpsertTable, hashed_part

EVENT_DAY = "event_day"

# Totals of a customer at a location.  A key can't be null, so an unknown location has an empty
# name and a mark.
LOCATION_TOTALS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("located", T.BooleanType()),
        T.StructField("place", T.StringType()),
        T.StructField("visits", T.LongType()),
        T.StructField("amount_sum", T.DecimalType(38, 2)),
        T.StructField("amount_cnt", T.LongType()),
        T.StructField("balance_max", T.DecimalType(12, 2)),
    ]
)


def raw_table(spark: SparkSession, path: str, parts: int = PARTS) -> InsertIgnoreTable:
    """Raw rows by hash of the id."""
    keys = ["transaction_id"]
    return InsertIgnoreTable(spark, path, RAW_TRANSACTIONS, keys, hashed_part(keys, parts))


def daily_archive(spark: SparkSession, path: str, parts: int = 4) -> InsertIgnoreTable:
    """Raw rows by hash of the id and, within it, by event day, for replays of some days.

    There are `parts` folders a day, so choose them by how much a day holds.
    """
    keys, day = ["transaction_id"], {EVENT_DAY: F.to_date("event_time")}
    part = hashed_part(keys, parts)
    return InsertIgnoreTable(spark, path, RAW_TRANSACTIONS, keys, part, also=day)


def alert_table(spark: SparkSession, path: str) -> InsertIgnoreTable:
    """Alerts by event day: an alert's id is made from its event, so it always has the same day.

    Rows to be stored carry their `event_time`.
    """
    return InsertIgnoreTable(spark, path, ANOMALIES, ["alert_id"], F.to_date("event_time"))


def profile_table(spark: SparkSession, path: str) -> UpsertTable:
    return UpsertTable(spark, path, PROFILES, ["customer_id"])


def totals_table(spark: SparkSession, path: str, parts: int = PARTS) -> UpsertTable:
    """Totals in partitions by customer, so that those of one customer lie together."""
    part = F.pmod(F.xxhash64("customer_id"), F.lit(parts))
    return UpsertTable(spark, path, LOCATION_TOTALS, ["customer_id", "located", "place"], part)


def archived_until(archive: InsertIgnoreTable, end: Column, start: Column | None = None) -> DataFrame:
    """Archived rows of the days up to `end`; folders of other days are not opened."""
    rows = archive.partitions().filter(F.col(EVENT_DAY) <= F.to_date(end))
    if start is not None:
        rows = rows.filter(F.col(EVENT_DAY) >= F.to_date(start))
    return rows.select(*archive.schema.names)
