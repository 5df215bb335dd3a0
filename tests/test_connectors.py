"""Connector settings.  No broker and no database is started, so only these are checked."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerwake.functions import events
from ledgerwake.operators import profile
from ledgerwake.plans import connected
from ledgerwake.schemas import ANOMALIES, RAW_TRANSACTIONS
from ledgerwake.sinks import layouts
from ledgerwake.sinks import jdbc as jdbc_sink
from ledgerwake.sinks import kafka as kafka_sink
from ledgerwake.sources import jdbc, kafka
from ledgerwake.sources.files import literal_rows

CONNECT = jdbc.connection("jdbc:postgresql://h/db", "u", "p", "org.postgresql.Driver")


def test_topic_options():
    options = kafka.topic_options("h:1", "t", kafka.starting_offsets("reprocess"), "g", 100, 8)
    assert options == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "t",
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "kafka.group.id": "g",
        "maxOffsetsPerTrigger": "100",
        "minPartitions": "8",
    }
    assert kafka.starting_offsets("realtime") == "latest"
    with pytest.raises(ValueError):
        kafka.starting_offsets("rewind")
    assert kafka_sink.publish_options("h:1", "t") == {
        "kafka.bootstrap.servers": "h:1",
        "topic": "t",
    }


def test_scan_options():
    plain = jdbc.scan_options(CONNECT, "raw_transactions")
    assert plain["dbtable"] == "raw_transactions" and "numPartitions" not in plain
    ranged = jdbc.scan_options(CONNECT, "t", "event_time", "2024-01-01", "2025-01-01", 64)
    assert (ranged["partitionColumn"], ranged["numPartitions"]) == ("event_time", "64")
    with pytest.raises(ValueError):
        jdbc.scan_options(CONNECT, "t", splits=4)
    with pytest.raises(ValueError):
        jdbc.scan_options(CONNECT, "t", "event_time")


def test_write_options_and_statements():
    assert jdbc_sink.write_options(CONNECT, "t")["batchsize"] == "10000"
    assert jdbc_sink.insert_ignore_statement("t", "s", ["a", "b"], ["a"]) == (
        "INSERT INTO t (a, b) SELECT a, b FROM s ON CONFLICT (a) DO NOTHING"
    )
    assert jdbc_sink.upsert_statement("t", "s", ["a", "b", "c"], ["a"]) == (
        "INSERT INTO t (a, b, c) SELECT a, b, c FROM s"
        " ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b, c = EXCLUDED.c"
    )


def test_literal_rows(spark):
    rows = literal_rows(spark, [("C_1", 1.5)], "customer_id string, amount double")
    assert rows.first().amount == 1.5


START, RUN = "2024-01-01 00:00:00", "2025-01-01 00:00:00"


@pytest.fixture
def stand_in(spark, folder, monkeypatch):
    """Files in place of topic and database; statements and settings are kept as they come."""
    lines = spark.range(400).select(
        F.concat(F.lit("T"), F.col("id") % 380).alias("transaction_id"),
        F.concat(F.lit("C"), F.col("id") % 7).alias("customer_id"),
        F.lit("1/1/90").alias("customer_dob"),
        F.lit("F").alias("customer_gender"),
        F.concat(F.lit("L"), F.col("id") % 3).alias("customer_location"),
        (F.col("id") * 1000.0).alias("customer_account_balance"),
        (F.col("id") * 700.0 + 1).alias("transaction_amount_inr"),
        F.timestamp_add("SECOND", F.col("id").cast("int") * 60, F.lit(START).cast("timestamp"))
        .alias("event_time"),
    )
    messages = events.to_messages(lines).select(F.col("value").cast("string"))
    broken = spark.createDataFrame([("{not json",)], "value string")
    messages.unionByName(broken).repartition(3).write.text(f"{folder}/topic")
    log = {"statements": [], "topics": []}
    stored = {
        connected.RAW: layouts.raw_table(spark, f"{folder}/raw"),
        connected.ALERTS: layouts.InsertIgnoreTable(spark, f"{folder}/alerts", ANOMALIES, ["alert_id"]),
        connected.CUSTOMERS: layouts.profile_table(spark, f"{folder}/profiles"),
    }

    def merge(df, statement, staging, connect):
        log["statements"].append(statement)
        table = stored[staging.removesuffix("_staging")]
        return table.insert(df) if statement.endswith("NOTHING") else table.upsert(df)

    def topic(reader, **options):
        log["topics"].append(kafka.topic_options(**options))
        return reader.text(f"{folder}/topic")

    monkeypatch.setattr(kafka, "read_batch", lambda spark, **o: topic(spark.read, **o))
    monkeypatch.setattr(
        kafka, "read_stream",
        lambda spark, **o: topic(spark.readStream.option("maxFilesPerTrigger", 1), **o),
    )
    monkeypatch.setattr(jdbc_sink, "merge", merge)
    monkeypatch.setattr(jdbc_sink, "append", lambda df, connect, table: stored[table].append(df))
    monkeypatch.setattr(jdbc_sink, "overwrite", lambda df, connect, table: stored[table].overwrite(df))
    monkeypatch.setattr(jdbc, "read", lambda spark, connect, table, **_: stored[table].read())
    good = events.good(events.decode(spark.read.text(f"{folder}/topic")))
    return log, stored, good


TOPIC = {"servers": "h:1", "topic": "t", "group": "g"}


def test_detection_from_topic_to_database(spark, folder, stand_in):
    log, stored, good = stand_in
    for _ in range(2):  # a restart finds nothing new
        connected.detect_topic(
            spark, TOPIC, CONNECT, f"{folder}/state", f"{folder}/rejected"
        ).awaitTermination()
    assert stored[connected.RAW].read().count() == 380
    found = stored[connected.ALERTS].read()
    assert found.count() > 0 and found.count() == found.select("alert_id").distinct().count()
    assert spark.read.parquet(f"{folder}/rejected/messages").count() == 1
    assert {o["startingOffsets"] for o in log["topics"]} == {"latest"}
    raw = [s for s in log["statements"] if s.startswith(f"INSERT INTO {connected.RAW} ")]
    assert len(raw) >= 3 and all(s.endswith("ON CONFLICT (transaction_id) DO NOTHING") for s in raw)


def test_replay_and_load_from_topic_to_database(spark, folder, stand_in):
    log, stored, good = stand_in
    end = F.lit("2024-01-01 05:00:00").cast("timestamp")
    connected.replay_topic(spark, TOPIC, CONNECT, end, f"{folder}/replay", RUN)
    (statement,) = log["statements"]
    assert "ON CONFLICT (customer_id) DO UPDATE SET avg_transaction = EXCLUDED" in statement
    rows = profile.reprocess_filter(good, end)
    wanted = profile.latest_profile(profile.window_profile(rows, run_ts=RUN))
    stored_rows = stored[connected.CUSTOMERS].read()
    assert stored_rows.count() == 7
    assert stored_rows.exceptAll(wanted.select(*stored_rows.columns)).isEmpty()
    assert {o["startingOffsets"] for o in log["topics"]} == {"earliest"}
    assert spark.read.parquet(f"{folder}/replay/messages").count() == 1


def test_profiles_of_a_database(spark, folder, stand_in):
    _, stored, good = stand_in
    stored[connected.RAW].insert(
        good.select(*[F.col(f.name).cast(f.dataType) for f in RAW_TRANSACTIONS]), ["event_time"]
    )
    found = connected.profile_database(spark, CONNECT, RUN)
    wanted = profile.batch_profile(stored[connected.RAW].read(), RUN)
    kept = [c for c in found.columns if c not in ("avg_transaction", "max_balance")]
    assert found.count() == 7
    assert found.select(*kept).exceptAll(wanted.select(*kept)).isEmpty()


def test_a_database_table_refuses_what_the_files_refuse(spark, folder, stand_in):
    """Ids repeat in the topic, and the raw table has a primary key."""
    with pytest.raises(ValueError):
        connected.load_topic(spark, TOPIC, CONNECT, f"{folder}/batch")
