from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerwake.functions import events
from ledgerwake.schemas import CSV_SCHEMA
from tests.samples import frame, txn

GOOD = (
    '{"TransactionID":"t","CustomerID":"c","CustomerDOB":null,"CustGender":"F",'
    '"CustLocation":"X","CustAccountBalance":NaN,"TransactionAmountINR":-5.5,'
    '"EventTime":"2025-01-01T00:03:00Z"}'
)


def decode(spark, *payloads):
    frame = spark.createDataFrame([(p,) for p in payloads], "value string")
    return events.decode(frame.select(F.col("value").cast("binary").alias("value")))


def test_good_message(spark):
    row = events.good(decode(spark, GOOD)).first()
    assert row.transaction_id == "t"
    assert math.isnan(row.customer_account_balance)
    assert row.transaction_amount_inr == -5.5
    assert str(row.event_time) == "2025-01-01 00:03:00"


def test_bad_messages_get_a_reason(spark):
    bad = {
        "{bad": events.BAD_JSON,
        "": events.BAD_JSON,
        None: events.BAD_JSON,
        "[1]": events.BAD_JSON,
        GOOD.replace("-5.5", '"abc"'): events.BAD_JSON,
        GOOD.replace("2025-01-01T00:03:00Z", "nonsense"): events.BAD_EVENT_TIME,
        GOOD.replace("2025-01-01T00:03:00Z", "2025"): events.BAD_EVENT_TIME,
        GOOD.replace('"2025-01-01T00:03:00Z"', "null"): events.NO_EVENT_TIME,
    }
    decoded = decode(spark, *bad, GOOD)
    found = {r.payload: r.decode_error for r in events.quarantine(decoded).collect()}
    assert found == bad
    assert events.good(decoded).count() == 1
    assert events.good(decoded, need_time=False).count() == 2


def test_messages_are_parsed_once(spark):
    plan = events.good(decode(spark, GOOD))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_encode_keeps_all_fields_and_no_nan(spark):
    rows = frame(spark, [txn("a", float("nan"), 2.5, customer_dob=None)])
    text = rows.select(events.encode(rows).alias("value")).first().value
    assert '"CustAccountBalance":null' in text and '"CustomerDOB":null' in text
    sent = events.to_messages(rows, key="customer_id")
    assert sent.columns == ["key", "value"]
    back = events.good(events.decode(sent)).first()
    assert back.transaction_amount_inr == 2.5


def test_message_bytes_counts_utf8(spark):
    row = spark.range(1).select(events.message_bytes(F.lit("é")).alias("n")).first()
    assert row.n == 2


def test_events_from_csv(spark):
    rows = spark.createDataFrame(
        [("c", "1/1/90", "F", "X", 10.0, "00:00:00", 5.0)] * 2, CSV_SCHEMA
    )
    fresh = events.events_from_csv(rows, "2025-01-01 10:20:30").collect()
    assert len({r.transaction_id for r in fresh}) == 2
    assert all(r.transaction_id.startswith("20250101102030-") for r in fresh)
    keyed = events.events_from_csv(rows, "2025-01-01 10:20:30", ["CustomerID"]).collect()
    assert len({r.transaction_id for r in keyed}) == 1


def test_lenient_decoding_keeps_rows_whose_fields_are_of_the_wrong_type(spark):
    def message(amount='5', time='"2025-01-01T00:01:00Z"', more=""):
        return '{"TransactionID":"a","TransactionAmountINR":%s,"EventTime":%s%s}' % (amount, time, more)

    cases = {
        message(): (5.0, None),
        message('"much"'): (None, None),
        message('"5.5"'): (5.5, None),
        message('{"x":1}'): (None, None),
        message("null"): (None, None),
        message(more=',"CustomerID":{"x":1},"Other":[1]'): (5.0, None),
        message(time='"soon"'): (5.0, events.BAD_EVENT_TIME),
        message(time="7"): (5.0, events.BAD_EVENT_TIME),
        message(time="null"): (5.0, events.NO_EVENT_TIME),
        message("NaN"): (None, events.BAD_JSON),
        "{bad": (None, events.BAD_JSON),
        "": (None, events.BAD_JSON),
        "[1]": (None, events.BAD_JSON),
        "5": (None, events.BAD_JSON),
    }
    rows = events.decode_lenient(spark.createDataFrame([(c,) for c in [*cases, None]], "value string"))
    strict = events.decode(spark.createDataFrame([("{}",)], "value string"))
    assert rows.schema.names == strict.schema.names
    assert [f.dataType for f in rows.schema] == [f.dataType for f in strict.schema]
    found = {r.payload: (r.transaction_amount_inr, r.decode_error) for r in rows.collect()}
    assert found == {**cases, None: (None, events.BAD_JSON)}
