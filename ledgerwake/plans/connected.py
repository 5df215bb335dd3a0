"""Whole jobs between a topic and a database, one call each.

`topic` holds the settings of `sources.kafka.topic_options`, without where to start; `connect`
those of `sources.jdbc.connection`.  Rejected rows and messages go to folders below `rejected_path`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerwake.functions import events
from ledgerwake.plans import jobs
from ledgerwake.schemas import ANOMALIES, PROFILES, RAW_TRANSACTIONS
from ledgerwake.sinks import files as file_sink
from ledgerwake.sinks.jdbc import DatabaseTable
from ledgerwake.sources import kafka
from ledgerwake.streaming import pipelines

RAW, ALERTS, CUSTOMERS = "raw_transactions", "anomaly_alerts", "customer_profiles"


def raw_rows(spark: SparkSession, connect: dict[str, str], table: str = RAW) -> DatabaseTable:
    return DatabaseTable(spark, connect, table, RAW_TRANSACTIONS, ["transaction_id"])


def alerts(spark: SparkSession, connect: dict[str, str], table: str = ALERTS) -> DatabaseTable:
    return DatabaseTable(spark, connect, table, ANOMALIES, ["alert_id"])


def profiles(spark: SparkSession, connect: dict[str, str], table: str = CUSTOMERS) -> DatabaseTable:
    return DatabaseTable(spark, connect, table, PROFILES, ["customer_id"])


def detect_topic(
    spark: SparkSession, topic: dict, connect: dict[str, str], checkpoint: str, rejected_path: str,
    trigger: dict | None = None, alert_table: str = ALERTS, raw_table: str = RAW, **options,
) -> StreamingQuery:
    """Live detection: alerts and raw rows of the topic into the database, from one read.

    The first start begins at the topic's end; later ones go on where the checkpoint stands.
    """
    start = kafka.starting_offsets("realtime")
    decoded = events.decode(kafka.read_stream(spark, **topic, starting=start))
    tables = alerts(spark, connect, alert_table), raw_rows(spark, connect, raw_table)
    return pipelines.speed_layer(decoded, *tables, checkpoint, rejected_path, trigger, **options)


def replay_topic(
    spark: SparkSession, topic: dict, connect: dict[str, str], end: Column, rejected_path: str,
    run_ts=None, profile_table: str = CUSTOMERS,
) -> None:
    """The topic from its beginning up to `end`: window profiles upserted into the database."""
    start = kafka.starting_offsets("reprocess")
    decoded = events.decode(kafka.read_batch(spark, **topic, starting=start))
    file_sink.overwrite(events.quarantine(decoded), f"{rejected_path}/messages")
    target = profiles(spark, connect, profile_table)
    jobs.replay_profiles(events.good(decoded), target, end, f"{rejected_path}/rows", run_ts)


def load_topic(
    spark: SparkSession, topic: dict, connect: dict[str, str], batch_path: str,
    raw_table: str = RAW,
) -> dict[str, int]:
    """The topic as it is now into the empty raw table; rows read, stored and rejected."""
    messages = kafka.read_batch(spark, **topic)
    return jobs.load_messages(messages, raw_rows(spark, connect, raw_table), batch_path)


def profile_database(
    spark: SparkSession, connect: dict[str, str], run_ts=None, raw_table: str = RAW,
    profile_table: str = CUSTOMERS, **split,
) -> DataFrame:
    """Profiles over all raw rows of the database replace those in it.  Returns the new ones.

    `split` places the ranges of `event_time`, or of another column, that are read side by side.
    """
    target = profiles(spark, connect, profile_table)
    jobs.rebuild_profiles(raw_rows(spark, connect, raw_table).read(**split), target, run_ts)
    return target.read()
