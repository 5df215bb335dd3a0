"""Declared schemas of events and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from ledgerwake.fixed_values import EVENT_TO_COLUMN

TEXT, NUMBER, WHOLE, MOMENT = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
STORED, REPORTED = T.DecimalType(12, 2), T.DecimalType(18, 2)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The event as it travels in JSON.  EventTime stays text here so that a bad time
# can be told apart from a missing one; decoding turns it into a timestamp.
EVENT_SCHEMA = _schema(
    TransactionID=TEXT,
    CustomerID=TEXT,
    CustomerDOB=TEXT,
    CustGender=TEXT,
    CustLocation=TEXT,
    CustAccountBalance=NUMBER,
    TransactionAmountINR=NUMBER,
    EventTime=TEXT,
)

TRANSACTION_COLUMNS = list(EVENT_TO_COLUMN.values())

RAW_TRANSACTIONS = _schema(
    transaction_id=TEXT,
    customer_id=TEXT,
    customer_dob=TEXT,
    customer_gender=TEXT,
    customer_location=TEXT,
    customer_account_balance=STORED,
    transaction_amount_inr=STORED,
    event_time=MOMENT,
)

ANOMALIES = _schema(
    alert_id=TEXT,
    customer_id=TEXT,
    transaction_id=TEXT,
    amount=REPORTED,
    location=TEXT,
    anomaly_reason=TEXT,
    detected_at=MOMENT,
    current_balance=REPORTED,
)

PROFILES = _schema(
    customer_id=TEXT,
    avg_transaction=NUMBER,
    max_balance=NUMBER,
    transaction_count=WHOLE,
    segment=TEXT,
    last_updated=MOMENT,
    top_location=TEXT,
)

CSV_SCHEMA = _schema(
    **{
        "CustomerID": TEXT,
        "CustomerDOB": TEXT,
        "CustGender": TEXT,
        "CustLocation": TEXT,
        "CustAccountBalance": NUMBER,
        "TransactionTime": TEXT,
        "TransactionAmount (INR)": NUMBER,
    }
)
