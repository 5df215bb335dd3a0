from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerwake.operators import profile, telemetry
from ledgerwake.plans import jobs
from ledgerwake.schemas import PROFILES, RAW_TRANSACTIONS
from ledgerwake.sinks.tables import UpsertTable
from tests.samples import at, frame, txn


def stored(spark, rows):
    exact = [
        {
            **r,
            "customer_account_balance": Decimal(str(r["customer_account_balance"])),
            "transaction_amount_inr": Decimal(str(r["transaction_amount_inr"])),
        }
        for r in rows
    ]
    return frame(spark, exact, RAW_TRANSACTIONS)


def test_segments_over_history(spark):
    def customer(name, amount, n):
        return [txn(f"{name}{i}", 1, amount, customer_id=name) for i in range(n)]

    rows = stored(
        spark,
        customer("ten", 50000, 10) + customer("eleven", 50000, 11) + customer("rich", 50000.01, 1),
    )
    found = {r.customer_id: r.segment for r in profile.batch_profile(rows).collect()}
    assert found == {"ten": "standard", "eleven": "frequent", "rich": "premium"}


def test_both_history_forms_agree(spark):
    rows = stored(
        spark,
        [
            txn(str(i), i * 7 % 13 - 9, i * 3 % 11, customer_id=None if i % 5 == 0 else f"c{i % 3}",
                customer_location=None if i % 7 == 0 else f"L{i % 4}")
            for i in range(60)
        ],
    )
    joined = profile.batch_profile_by_join(rows, "2025-01-01 00:00:00")
    single = profile.batch_profile(rows, "2025-01-01 00:00:00")
    assert joined.schema["avg_transaction"].dataType == single.schema["avg_transaction"].dataType
    assert joined.exceptAll(single).isEmpty() and single.exceptAll(joined).isEmpty()
    anonymous = single.filter(F.col("customer_id").isNull()).first()
    assert anonymous.transaction_count == 12 and anonymous.top_location is None
    halves = profile.merge_partials(
        profile.location_partials(rows.filter("cast(transaction_id as int) < 20")),
        profile.location_partials(rows.filter("cast(transaction_id as int) >= 20")),
    )
    merged = profile.profile_from_partials(halves, "2025-01-01 00:00:00")
    assert merged.exceptAll(single).isEmpty()


def test_location_ties(spark):
    rows = stored(
        spark,
        [
            txn("1", -5, 1, customer_location="X", event_time=at("00:01:00")),
            txn("2", -9, 1, customer_location="Y", event_time=at("00:02:00")),
            txn("3", -9, 1, customer_location="Y", event_time=at("00:03:00")),
            txn("4", -9, 1, customer_location="X", event_time=at("00:04:00")),
        ],
    )
    history = profile.batch_profile(rows).first()
    window = profile.window_profile(rows).first()
    assert (history.top_location, window.top_location) == ("Y", "X")
    assert (history.max_balance, window.max_balance) == (Decimal("-5.00"), 0.0)


def test_windows(spark):
    rows = frame(
        spark,
        [
            txn("1", 1.0, 15000.0, event_time=at("00:01:00"), customer_location=None),
            txn("2", 1.0, 15000.0, event_time=at("00:02:00"), customer_location=None),
            txn("3", 1.0, 15000.0, event_time=at("00:03:00")),
            txn("4", 1.0, 15000.01, event_time=at("00:05:00")),
        ],
    )
    windows = profile.window_profile(rows)
    first, second = windows.orderBy("window_start").collect()
    assert (first.transaction_count, first.segment, first.top_location) == (3, "regular", None)
    assert (second.window_start, second.segment) == (at("00:05:00"), "premium")
    latest = profile.latest_profile(windows).collect()
    assert [r.window_start for r in latest] == [at("00:05:00")]


def test_reprocess_filter(spark):
    rows = frame(
        spark,
        [
            txn("old", 1.0, 1.0, event_time=at("00:00:00")),
            txn("edge", 1.0, 1.0, event_time=at("01:00:00")),
            txn("late", 1.0, 1.0, event_time=at("01:00:01")),
            txn("none", 1.0, 1.0, event_time=None),
        ],
    )
    end = F.lit(at("01:00:00"))
    ids = {r.transaction_id for r in profile.reprocess_filter(rows, end).collect()}
    assert ids == {"old", "edge"}
    start = end - F.expr("interval 10 minutes")
    ids = {r.transaction_id for r in profile.reprocess_filter(rows, end, start).collect()}
    assert ids == {"edge"}


def test_replay_keeps_what_it_cannot_profile(spark, folder):
    rows = frame(
        spark,
        [
            txn("1", 5.0, 1.0, event_time=at("00:01:00")),
            txn("2", 6.0, 3.0, event_time=at("00:07:00")),
            txn("3", None, 3.0, event_time=at("00:08:00")),
            txn("4", 9.0, 3.0, event_time=at("02:00:00")),
        ],
    )
    table = UpsertTable(spark, f"{folder}/profiles", PROFILES, ["customer_id"])
    for _ in range(2):
        jobs.replay_profiles(rows, table, F.lit(at("01:00:00")), f"{folder}/rejected")
        kept = table.read().collect()
        assert [(r.transaction_count, r.max_balance) for r in kept] == [(1, 6.0)]
    rejected = spark.read.parquet(f"{folder}/rejected").collect()
    assert [r.transaction_id for r in rejected] == ["3"]


def test_merged_latency_sketches_are_within_their_bound(spark):
    alerts = spark.range(40000).selectExpr(
        "timestamp_seconds(id * 7) as event_time",
        "timestamp_millis(id * 7000 + (id % 1009) * (id % 1009)) as detected_at",
    )
    hourly = telemetry.latency_sketches(alerts, "1 hour")
    daily = telemetry.merge_latency(hourly, "1 day")
    delays = [[], [], [], []]
    for n in range(40000):
        delays[n * 7 // 86400].append((n % 1009) ** 2)
    for share in (0.05, 0.5, 0.95):
        found = telemetry.latency_quantile(daily, share).orderBy("interval_start").collect()
        assert [r.n for r in found] == [len(d) for d in delays]
        for row, own in zip(found, delays):
            low = sum(d < row.delay_ms for d in own) / len(own)
            high = sum(d <= row.delay_ms for d in own) / len(own)
            assert low - telemetry.RANK_ERROR <= share <= high + telemetry.RANK_ERROR
