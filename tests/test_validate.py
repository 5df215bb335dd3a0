from __future__ import annotations

import math

import pytest

from ledgerwake.operators import keyed, validate
from ledgerwake.schemas import RAW_TRANSACTIONS
from tests.samples import at, frame, txn


def test_raw_transaction_checks(spark):
    rows = frame(
        spark,
        [
            txn("fine", 1.0, 1.0),
            txn("no gender", 1.0, 1.0, customer_gender=None),
            txn("gender", 1.0, 1.0, customer_gender="Z"),
            txn("long", 1.0, 1.0, customer_gender="MF"),
            txn("wide", 1e12, 1.0),
            txn("nan", 1.0, float("nan")),
            txn("bare", None, None, customer_id=None, event_time=None),
        ],
    )
    checks = validate.raw_transaction_checks(rows)
    valid, rejected = validate.split(rows, checks)
    assert {r.transaction_id for r in valid.collect()} == {"fine", "no gender"}
    assert valid.columns == rows.columns
    assert {r.transaction_id: r.reject_reasons for r in rejected.collect()} == {
        "gender": ["customer_gender_not_allowed"],
        "long": ["customer_gender_not_allowed", "customer_gender_too_long"],
        "wide": ["customer_account_balance_overflow"],
        "nan": ["transaction_amount_inr_missing"],
        "bare": ["customer_id_missing", "transaction_amount_inr_missing", "event_time_missing"],
    }
    counts = {r.reject_reason: r.n for r in validate.reject_counts(rows, checks).collect()}
    assert counts["transaction_amount_inr_missing"] == 2
    stored = validate.conform(valid, RAW_TRANSACTIONS)
    assert stored.schema.simpleString() == RAW_TRANSACTIONS.simpleString()


def test_alert_and_measure_checks(spark):
    alert = spark.createDataFrame(
        [("c" * 256, "t", 1.0, "X", "r", None)],
        "customer_id string, transaction_id string, amount double, location string,"
        " anomaly_reason string, current_balance double",
    )
    _, rejected = validate.split(alert, validate.alert_checks(alert))
    assert rejected.first().reject_reasons == ["current_balance_missing", "customer_id_too_long"]
    rows = frame(spark, [txn("a", None, 1.0), txn("b", 1.0, 1.0)])
    ready, _ = validate.split(rows, validate.measure_checks(rows))
    assert [r.transaction_id for r in ready.collect()] == ["b"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        validate.require_columns(spark.createDataFrame([(1,)], "a int"), "a", "b")


def test_first_and_latest_per_key(spark):
    rows = frame(
        spark,
        [
            txn("a", 1.0, 2.0, event_time=at("00:02:00")),
            txn("a", 1.0, 1.0, event_time=at("00:01:00")),
            txn("b", 1.0, 7.0),
        ],
    )
    first = keyed.first_per_key(rows, ["transaction_id"], ["event_time"])
    last = keyed.latest_per_key(rows, ["transaction_id"], ["event_time"])
    assert first.columns == rows.columns
    assert {r.transaction_id: r.transaction_amount_inr for r in first.collect()} == {"a": 1, "b": 7}
    assert {r.transaction_id: r.transaction_amount_inr for r in last.collect()} == {"a": 2, "b": 7}
    assert keyed.first_per_key(rows.select("transaction_id"), ["transaction_id"], []).count() == 2
    assert [tuple(r) for r in keyed.duplicate_keys(rows, ["transaction_id"]).collect()] == [("a", 2)]
    assert tuple(keyed.duplicate_total(rows, ["transaction_id"]).first()) == (1, 1)


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A key with a third of all rows crosses the shuffle once per task."""
    rows = spark.range(0, 9000, 1, 6).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) as k", "id as v"
    )
    first = keyed.first_per_key(rows, ["k"], ["v"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert first.count() == 6001
    assert first.filter("k = 'hot'").first().v == 0


def test_a_value_without_room_never_becomes_null(spark):
    rows = frame(spark, [txn("wide", 1.0, 1e20)])
    with pytest.raises(Exception, match="does not fit"):
        validate.conform(rows, RAW_TRANSACTIONS).collect()
    missing = frame(spark, [txn("nan", math.nan, 5.0)])
    stored = validate.conform(missing, RAW_TRANSACTIONS).first()
    assert stored.customer_account_balance is None


def test_a_row_without_key_is_refused(spark):
    rows = frame(spark, [txn(None, 1.0, 5.0)])
    with pytest.raises(Exception, match="lacks its key"):
        validate.keyed_rows(rows, ["transaction_id"]).collect()
