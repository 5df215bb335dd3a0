from __future__ import annotations

import glob
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.functions import events
from ledgerwake.functions.scalars import packed_id
from ledgerwake.operators import detect, profile, validate
from ledgerwake.plans import catalogue, jobs
from ledgerwake.schemas import ANOMALIES, CSV_SCHEMA, PROFILES, RAW_TRANSACTIONS, TRANSACTION_COLUMNS
from ledgerwake.session import setting
from ledgerwake.sinks import layouts
from ledgerwake.sinks.tables import InsertIgnoreTable, UpsertTable
from ledgerwake.sources import files, tables
from ledgerwake.streaming import pipelines
from ledgerwake.streaming.progress import BatchCounts
from tests.samples import at, frame, txn

SLICES = [
    [
        txn("1", 100.0, 60.0, event_time=at("00:01:00")),
        txn("2", 100.0, 10.0, event_time=at("00:02:00"), customer_location="Y"),
        txn("3", 10.0, 20.0, event_time=at("00:04:00"), customer_id="d"),
    ],
    [
        txn("4", 200.0, 5.0, event_time=at("00:06:00"), customer_location="Y"),
        txn("1", 999.0, 1.0, event_time=at("00:03:30")),
    ],
    [txn("5", 200.0, 5.0, event_time=at("00:30:00"))],
]


def topic(spark, folder, slices, extra=()):
    """One text file per slice, in order of arrival."""
    for position, rows in enumerate(slices):
        text = events.to_messages(frame(spark, rows)).select("value")
        bad = [(line,) for line in extra] if position == 0 else []
        if bad:
            text = text.unionByName(spark.createDataFrame(bad, "value string"))
        text.coalesce(1).write.mode("append").text(f"{folder}/topic")
        time.sleep(0.05)
    return events.decode(files.stream_messages(spark, f"{folder}/topic", 1))


def batch_rows(spark, slices):
    return frame(spark, [row for rows in slices for row in rows])


def test_window_profiles_equal_batch_for_closed_windows(spark, folder):
    stream = events.good(topic(spark, folder, SLICES))
    profiles = pipelines.profile_stream(
        stream, F.lit("2100-01-01").cast("timestamp"), run_ts="2025-02-01"
    )
    query = pipelines.start(profiles, "windows", f"{folder}/state", path=f"{folder}/out")
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    streamed = spark.read.schema(profiles.schema).parquet(f"{folder}/out")
    whole = profile.window_profile(batch_rows(spark, SLICES), run_ts="2025-02-01")
    closed = whole.filter(F.col("window_end") <= F.lit(at("00:28:00")))
    assert closed.count() == 3
    assert closed.exceptAll(streamed).isEmpty() and streamed.exceptAll(closed).isEmpty()


def test_late_rows_are_dropped_and_counted(spark, folder):
    late = [txn("late", 1.0, 1.0, event_time=at("00:01:00"))]
    filler = [txn("6", 1.0, 1.0, event_time=at("00:31:00"))]
    stream = events.good(topic(spark, folder, [SLICES[0], SLICES[2], filler, late]))
    profiles = pipelines.profile_stream(stream, F.lit("2100-01-01").cast("timestamp"))
    query = pipelines.start(profiles, "late", f"{folder}/state", path=f"{folder}/out")
    query.awaitTermination()
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
    assert dropped == 1
    out = spark.read.schema(profiles.schema).parquet(f"{folder}/out")
    counts = {(r.customer_id, r.window_start): r.transaction_count for r in out.collect()}
    assert counts == {("c", at("00:00:00")): 2, ("d", at("00:00:00")): 1}


def speed(spark, decoded, folder, state):
    alerts = layouts.alert_table(spark, f"{folder}/alerts")
    archive = layouts.daily_archive(spark, f"{folder}/archive")
    pipelines.speed_layer(
        decoded, alerts, archive, f"{folder}/{state}", f"{folder}/rejected-{state}"
    ).awaitTermination()
    return alerts, archive


def test_speed_layer_with_replay(spark, folder):
    decoded = topic(spark, folder, SLICES, extra=["{bad"])
    alerts, archive = speed(spark, decoded, folder, "state")
    stored = {r.transaction_id: float(r.transaction_amount_inr) for r in archive.read().collect()}
    assert stored == {"1": 60.0, "2": 10.0, "3": 20.0, "4": 5.0, "5": 5.0}
    found = sorted((r.transaction_id, r.anomaly_reason) for r in alerts.read().collect())
    assert found == [
        ("1", "high_value_relative"),
        ("3", "high_value_relative"),
        ("3", "overdraft_attempt"),
    ]
    aside = spark.read.parquet(f"{folder}/rejected-state/messages")
    assert [(r.decode_error, r.payload) for r in aside.collect()] == [("malformed_json", "{bad")]
    before = sorted(r.alert_id for r in alerts.read().collect())
    alerts, archive = speed(spark, decoded, folder, "second-state")
    assert sorted(r.alert_id for r in alerts.read().collect()) == before
    assert archive.read().count() == 5


def test_single_pipeline(spark, folder):
    stream = events.good(topic(spark, folder, SLICES))
    alerts = InsertIgnoreTable(spark, f"{folder}/alerts", ANOMALIES, ["alert_id"])
    for query in pipelines.single_pipeline(
        stream, "realtime", f"{folder}/live", f"{folder}/aside", alerts=alerts
    ):
        query.awaitTermination()
    expected = detect.alerts(detect.detect(batch_rows(spark, SLICES), "keep"))
    ids = {r.alert_id for r in alerts.read().collect()}
    assert ids == {r.alert_id for r in expected.collect()}
    profiles = UpsertTable(spark, f"{folder}/profiles", PROFILES, ["customer_id"])
    for attempt in ("replay", "replay-again"):
        aside = f"{folder}/{attempt}-aside"
        for query in pipelines.single_pipeline(
            stream, "reprocess", f"{folder}/{attempt}", aside, profiles=profiles
        ):
            query.awaitTermination()
        ready, rejected = validate.split(
            batch_rows(spark, SLICES), validate.measure_checks(batch_rows(spark, SLICES))
        )
        kept_aside = spark.read.schema(rejected.schema).parquet(aside)
        assert kept_aside.count() == rejected.count()
        kept = {r.customer_id: (r.transaction_count, r.max_balance) for r in profiles.read().collect()}
        assert kept == {"c": (1, 200.0), "d": (1, 10.0)}


def test_rows_without_time_are_set_aside_in_real_time(spark, folder):
    rows = [txn("timed", 1.0, 60.0, event_time=at("00:01:00")), txn("untimed", 1.0, 60.0, event_time=None)]
    table = layouts.alert_table(spark, f"{folder}/alerts")
    pipelines.alerts_to(table, f"{folder}/aside", "keep")(frame(spark, rows), 0)
    assert {r.transaction_id for r in table.read().collect()} == {"timed"}
    aside = spark.read.parquet(pipelines.untimed_path(f"{folder}/aside") + "/batch=0").collect()
    assert [(r.transaction_id, r.reject_reasons) for r in aside] == [("untimed", ["event_time_missing"])]


def test_a_replay_ends_for_rejected_rows_too(spark, folder):
    rows = [
        txn("in", 1.0, None, event_time=at("00:01:00")),
        txn("after", 1.0, None, event_time=at("00:09:00")),
        txn("untimed", 1.0, 1.0, event_time=None),
    ]
    rows_in = frame(spark, rows)
    rows_in.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows_in.schema).parquet(f"{folder}/in")
    queries = pipelines.single_pipeline(
        stream, "reprocess", f"{folder}/state", f"{folder}/aside",
        profiles=layouts.profile_table(spark, f"{folder}/profiles"), end=F.lit(at("00:05:00")),
    )
    for query in queries:
        query.awaitTermination()
    kept = spark.read.schema(rows_in.schema).parquet(f"{folder}/aside").collect()
    assert {r.transaction_id for r in kept} == {"in", "untimed"}


def test_an_archive_replay_opens_only_its_days(spark, folder):
    archive = layouts.daily_archive(spark, folder, parts=1)
    days = [f"2024-01-0{n} 10:00:00" for n in (1, 2, 3)]
    archive.insert(frame(spark, [txn(str(n), 1.0, 1.0, event_time=datetime.fromisoformat(d)) for n, d in enumerate(days)]))
    spoilt = glob.glob(f"{folder}/**/event_day=2024-01-03/*.parquet", recursive=True)
    assert spoilt
    for name in spoilt:
        with open(name, "wb") as file:
            file.write(b"spoilt")
        with open(f"{os.path.dirname(name)}/.{os.path.basename(name)}.crc", "wb") as file:
            file.write(b"")
    end = F.lit("2024-01-02 12:00:00").cast("timestamp")
    found = layouts.archived_until(archive, end)
    assert sorted(r.transaction_id for r in found.collect()) == ["0", "1"]
    assert [r.transaction_id for r in layouts.archived_until(archive, end, end).collect()] == ["1"]


def test_batch_counts_of_a_restarted_query(spark, folder):
    decoded, broken = topic(spark, folder, SLICES), []

    def break_once(batch, batch_id):
        if batch_id == 1 and not broken:
            broken.append(batch_id)
            raise RuntimeError("ended")

    with BatchCounts(spark, "restarted", f"{folder}/counts") as counts:
        for attempt in range(2):
            query = pipelines.start(decoded, "restarted", f"{folder}/state", steps=[break_once])
            if attempt:
                query.awaitTermination()
            else:
                with pytest.raises(Exception, match="ended"):
                    query.awaitTermination()
    assert sorted(map(tuple, counts.read().collect())) == [(0, 3, 0), (1, 2, 0), (2, 1, 0)]


def test_balance_of_a_repeated_batch(spark, folder):
    archive = layouts.raw_table(spark, f"{folder}/archive")
    step = pipelines.archive_to(archive, f"{folder}/aside", balance_path=f"{folder}/balance")
    bad = txn("9", 1.0, 1.0, event_time=at("00:07:00"), customer_gender="Q")
    batches = [frame(spark, SLICES[0]), frame(spark, [*SLICES[1], bad])]
    for number, batch in enumerate(batches):
        step(batch, number)
    step(batches[1], 1)
    notes = spark.read.schema(f"{pipelines.BALANCE}, batch int").parquet(f"{folder}/balance").collect()
    assert sorted((r.batch, r.offered, r.added, r.rejected) for r in notes) == [(0, 3, 3, 0), (1, 3, 1, 1)]


def test_live_history_with_gaps_equals_batch(spark, folder):
    rows = [
        *SLICES[0], *SLICES[1],
        txn("7", None, 5.0, event_time=at("00:06:30"), customer_location=None),
        txn("8", 5.0, None, event_time=at("00:06:40"), customer_location=""),
        txn("9", 5.0, 1.0, event_time=at("00:06:50"), customer_id=None),
    ]
    totals = layouts.totals_table(spark, f"{folder}/totals")
    profiles = layouts.profile_table(spark, f"{folder}/profiles")
    decoded = events.good(topic(spark, folder, [rows[:4], rows[4:]]))
    pipelines.live_history(
        decoded, totals, profiles, f"{folder}/state", f"{folder}/aside", "2025-02-01"
    ).awaitTermination()
    typed = validate.narrow(
        frame(spark, rows), "decimal(12,2)", "customer_account_balance", "transaction_amount_inr"
    )
    whole = validate.conform(
        profile.batch_profile(typed.filter("customer_id is not null"), "2025-02-01"), PROFILES
    )
    assert sorted(map(tuple, profiles.read().collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert spark.read.parquet(f"{folder}/aside").count() == 1


def test_first_rows_within_watermark(spark, folder):
    stream = pipelines.first_rows(events.good(topic(spark, folder, SLICES)), "1 hour")
    pipelines.start(
        stream, "first", f"{folder}/state", path=f"{folder}/out"
    ).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
    assert sorted(r.transaction_id for r in rows) == ["1", "2", "3", "4", "5"]
    assert stream.columns == TRANSACTION_COLUMNS


def test_alerts_without_room_are_set_aside(spark, folder):
    table = InsertIgnoreTable(spark, f"{folder}/alerts", ANOMALIES, ["alert_id"])
    batch = frame(spark, [txn("wide", 1.0, 1e20), txn("fine", 1.0, 5.0)])
    pipelines.alerts_to(table, f"{folder}/aside", "drop")(batch, 0)
    assert {r.transaction_id for r in table.read().collect()} == {"fine"}
    aside = spark.read.parquet(f"{folder}/aside/batch=0").collect()
    assert {r.transaction_id for r in aside} == {"wide"}
    assert aside[0].reject_reasons == ["amount_overflow"]


def test_csv_files_with_bad_headers_are_set_aside(spark, folder):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    os.makedirs(f"{folder}/in")
    texts = ["id,n\na,1\nb,x\n", "n,note,id\n2,y,c\n", "id,n,n\nd,3,4\n", "id\ne\n"]
    for number, text in enumerate(texts):
        with open(f"{folder}/in/{number}.csv", "w") as file:
            file.write(text)
    kept = []
    pipelines.csv_stream(
        files.stream_csv_paths(spark, f"{folder}/in", 3), schema,
        lambda good, _: kept.extend(map(tuple, good.collect())), f"{folder}/state", f"{folder}/aside",
    ).awaitTermination()
    assert sorted(kept) == [("a", 1), ("c", 2)]
    aside = spark.read.parquet(f"{folder}/aside").collect()
    found = sorted((os.path.basename(r.file), r.reject_reasons[0]) for r in aside)
    assert [name for name, _ in found] == ["0.csv", "2.csv", "3.csv"]
    assert found[0][1] == "n_unfit" and "more than once: n" in found[1][1] and "n" in found[2][1]


def test_csv_problems_are_named_and_a_staged_split_parses_once(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/empty.csv", "w"):
        pass
    with pytest.raises(ValueError, match="empty"):
        files.split_csv(spark, f"{folder}/empty.csv")
    with open(f"{folder}/rows.csv", "w") as file:
        file.write("id,n\na,1\nb,x\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    good, rejected = files.split_csv(spark, f"{folder}/rows.csv", schema, stage=f"{folder}/judged")
    os.remove(f"{folder}/rows.csv")
    assert [r.id for r in good.collect()] == ["a"] and [r.id for r in rejected.collect()] == ["b"]


def test_large_slices_are_several_files_of_one_micro_batch(spark, folder, monkeypatch):
    days = [(n, datetime(2024, 1, 1 + n % 28), n % 3, "view", 500.0, '{"k": 50}') for n in range(400)]
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(days, kind).repartition(1).write.parquet(f"{folder}/sf/events.parquet")
    found = {}
    for rows_of_a_file in (1000, 25):
        monkeypatch.setattr(tables, "SLICE_ROWS", rows_of_a_file)
        balance = catalogue.stream_balance(spark, f"{folder}/sf").collect()
        latency = catalogue.live_latency(spark, f"{folder}/sf").collect()
        found[rows_of_a_file] = sorted(balance), sorted(latency)
    assert found[1000] == found[25] and len(found[25][0]) == 4
    topic = catalogue._sent(spark, f"{folder}/sf", f"{folder}/sent")
    assert len(glob.glob(f"{folder}/sent/topic/part-*")) == 4 * 5
    assert topic.isStreaming


def small_lines(spark, sf_dir):
    """The tables that lines are made of, one file each."""
    day = datetime(2024, 1, 5)
    made = {
        "nation": ([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
        "supplier": ([(n, n % 2) for n in range(20)], "s_suppkey long, s_nationkey int"),
        "customer": ([(n, "ABFH"[n % 4], 10.0 * n) for n in range(8)], "c_custkey long, c_mktsegment string, c_acctbal double"),
        "orders": ([(n, n % 8, day) for n in range(40)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": (
            [(n % 40, n % 7 + 1, n, n % 20, 1.5 * n, "RN"[n % 2], day) for n in range(600)],
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
            "l_returnflag string, l_shipdate timestamp_ntz",
        ),
    }
    for name, (cells, kind) in made.items():
        spark.createDataFrame(cells, kind).coalesce(1).write.parquet(f"{sf_dir}/{name}.parquet")


def test_large_csv_parts_are_several_files_of_one_micro_batch(spark, folder, monkeypatch):
    small_lines(spark, f"{folder}/sf")
    root = spark.conf.get("spark.checkpoint.dir")
    found = {}
    for rows_of_a_file, files_of_a_part in ((1000, 1), (40, 6)):
        monkeypatch.setattr(tables, "CSV_ROWS", rows_of_a_file)
        before = set(glob.glob(f"{root}/csv-stream-*"))
        found[rows_of_a_file] = sorted(map(str, catalogue.csv_stream(spark, f"{folder}/sf").collect()))
        (made,) = set(glob.glob(f"{root}/csv-stream-*")) - before
        assert len(glob.glob(f"{made}/in/part-*")) == 3 * files_of_a_part
        assert len(glob.glob(f"{made}/out/batch=*")) == 3
    assert found[1000] == found[40] and len(found[40]) == 600


def test_bulk_loaded_messages_take_a_part_of_their_length(spark, folder):
    small_lines(spark, f"{folder}/sf")
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/bulk-load-*"))
    loaded = catalogue.bulk_load_events(spark, f"{folder}/sf").collect()
    assert sum(r.n for r in loaded) == 600
    (made,) = set(glob.glob(f"{root}/bulk-load-*")) - before
    long = spark.read.text(f"{made}/topic").agg(F.sum(F.length("value") + 1)).first()[0]
    assert 2 * sum(map(os.path.getsize, glob.glob(f"{made}/topic/part-*"))) < long


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {path for made in folders for path in glob.glob(f"{made}/*/shuffle_*")}


def test_bulk_load_leaves_nothing_but_its_messages_on_disk(spark, folder, monkeypatch):
    small_lines(spark, f"{folder}/sf")
    root, load, left = spark.conf.get("spark.checkpoint.dir"), jobs.bulk_load, []

    def loaded(*given):
        until = time.time() + 20
        while shuffle_files(spark) - shuffles and time.time() < until:
            time.sleep(0.1)
        left.extend(shuffle_files(spark) - shuffles)
        return load(*given)

    monkeypatch.setattr(jobs, "bulk_load", loaded)
    folders, shuffles = set(glob.glob(f"{root}/*")), shuffle_files(spark)
    rows = catalogue.bulk_load_events(spark, f"{folder}/sf").collect()
    assert sum(r.n for r in rows) == sum(r.n_ids for r in rows) == 600
    (made,) = set(glob.glob(f"{root}/*")) - folders
    assert left == [] and sorted(os.listdir(made)) == ["rejected", "topic"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"


def test_bulk_load_sets_aside_what_does_not_fit(spark, folder):
    schema = T.StructType([*CSV_SCHEMA.fields, T.StructField("key", T.LongType())])
    line = "c{},1/1/90,F,X,{},10:00,5.0,{}\n"
    lines = [line.format(n, 10.0 * n, n) for n in range(6)]
    bad = [line.format(6, "much", 6), "c7,1/1/90\n", line.format(8, 1.0, "x")]
    os.makedirs(folder)
    for name, some in (("mixed", lines[:3] + bad + lines[3:]), ("clean", lines), ("none", [])):
        with open(f"{folder}/{name}.csv", "w") as file:
            file.writelines([",".join(schema.names) + "\n", *some])
        sent = jobs.bulk_load(
            spark, f"{folder}/{name}.csv", lambda messages: messages.write.text(f"{folder}/{name}"),
            f"{folder}/rejected", "2024-02-01 00:00:00", ["key"], schema,
        )
        messages = events.good(events.decode(spark.read.text(f"{folder}/{name}"))).collect()
        good = [] if name == "none" else [(f"c{n}", 10.0 * n, 5.0) for n in range(6)]
        assert sent == len(good) and sorted(
            (m.customer_id, m.customer_account_balance, m.transaction_amount_inr) for m in messages
        ) == good
        aside = spark.read.parquet(f"{folder}/rejected")
        assert aside.columns == [*schema.names, "_ragged_line", "reject_reasons"]
        found = sorted(r.reject_reasons[0] for r in aside.collect())
        assert found == (["CustAccountBalance_unfit", "key_unfit", "ragged"] if name == "mixed" else [])


def test_places_of_few_suppliers_are_sent_instead_of_shuffling_lines(spark, folder, monkeypatch):
    small_lines(spark, f"{folder}/sf")
    found = {}
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        for most in (19, 20):
            monkeypatch.setattr(tables, "SENT_PLACES", most)
            rows = tables.line_transactions(spark, f"{folder}/sf", True)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(l_suppkey" in plan) == (most == 19)
            found[most] = sorted(map(str, rows.collect()))
    assert found[19] == found[20] and len(found[20]) == 600


def test_packed_ids_differ_where_their_texts_do(spark):
    digest = "0123456789abcdef" * 2
    texts = [
        None, "", "-", digest, digest.upper(), f"{digest}\n", f"{digest}0", digest[1:], f"20240201000000-{digest}",
        f"20240201000001-{digest}", f"20240201000000-{digest[::-1]}", f"\U0001f4b0é-{digest}", f"\x01-{digest}", "\x01",
    ]
    rows = spark.createDataFrame([(t,) for t in 2 * texts], "id string").select("id", packed_id(F.col("id")).alias("packed"))
    assert rows.filter("id IS NULL").select("packed").distinct().collect() == [(None,)]
    assert rows.agg(F.count_distinct("packed")).first()[0] == len(texts) - 1
    assert rows.filter("packed IS NULL AND id IS NOT NULL").isEmpty()
    assert {len(r.packed) for r in rows.collect() if r.id and r.id.startswith("2024")} == {32}
