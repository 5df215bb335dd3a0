from __future__ import annotations

import math

import pytest

from ledgerwake.operators import detect
from tests.samples import frame, txn

R, A, O = "high_value_relative", "high_value_absolute", "overdraft_attempt"
CASES = [
    ("all_three", 10000.0, 60000.0, [R, A, O]),
    ("relative_only", 100.0, 60.0, [R]),
    ("exactly_half", 100.0, 50.0, []),
    ("exactly_limit", 1000000.0, 50000.0, []),
    ("withdrawal", 1000000.0, -60000.0, [A]),
    ("negative_balance", -10.0, 0.0, [R, O]),
    ("all_of_it", 100.0, 100.0, [R]),
    ("no_amount", 100.0, None, []),
    ("no_balance", None, 60000.0, []),
    ("nan_amount", 100.0, math.nan, []),
    ("nan_balance", math.nan, 60000.0, [A]),
    ("nan_both", math.nan, math.nan, []),
]


def test_rules(spark):
    rows = frame(spark, [txn(name, b, a) for name, b, a, _ in CASES])
    found = {}
    for row in detect.detect(rows, "keep").collect():
        found.setdefault(row.transaction_id, []).append(row.anomaly_reason)
    assert found == {name: reasons for name, _, _, reasons in CASES if reasons}


def test_incomplete_rows(spark):
    rows = frame(
        spark,
        [
            txn("a", 1.0, 5.0, customer_location=None),
            txn("b", 1.0, 5.0, customer_id=None),
            txn(None, 1.0, 5.0),
            txn("d", 1.0, 5.0, event_time=None),
            txn("e", 1.0, 5.0),
        ],
    )
    dropped = {r.transaction_id for r in detect.detect(rows, "drop").collect()}
    kept = {r.transaction_id for r in detect.detect(rows, "keep").collect()}
    assert dropped == {"d", "e"}
    assert kept == {"a", "b", None, "e"}
    with pytest.raises(ValueError):
        detect.detect(rows, "maybe")


def test_alert_ids_repeat_and_tell_events_apart(spark):
    rows = frame(spark, [txn("a", 1.0, 5.0), txn("a", 1.0, 6.0)])
    once = {r.alert_id for r in detect.alerts(detect.detect(rows)).collect()}
    again = {r.alert_id for r in detect.alerts(detect.detect(rows.repartition(3))).collect()}
    assert once == again
    assert len(once) == 4


def test_alert_ids_do_not_depend_on_the_type(spark):
    rows = frame(spark, [txn("a", 1.0, 5.25), txn("b", 100.5, 60000.0)])
    stored = rows.withColumns(
        {
            c: rows[c].cast("decimal(12,2)")
            for c in ("customer_account_balance", "transaction_amount_inr")
        }
    )
    ids = [{r.alert_id for r in detect.alerts(detect.detect(x)).collect()} for x in (rows, stored)]
    assert ids[0] == ids[1]


def test_detection_has_no_shuffle(spark):
    plan = detect.detect(frame(spark, [txn("a", 1.0, 5.0)]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_display(spark):
    line = detect.display(detect.detect(frame(spark, [txn("a", 9.0, 5.0)])), "Anomaly")
    assert line.first().line.startswith('[Anomaly] {"customer_id":"c","transaction_id":"a"')
