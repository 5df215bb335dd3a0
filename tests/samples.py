"""Hand-written transactions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

from ledgerwake.schemas import RAW_TRANSACTIONS

DOUBLES = T.StructType(
    [
        T.StructField(f.name, T.DoubleType() if f.name.endswith(("balance", "inr")) else f.dataType)
        for f in RAW_TRANSACTIONS
    ]
)
ORDER = RAW_TRANSACTIONS.names


def at(clock: str, day: int = 1) -> datetime:
    hour, minute, second = (int(x) for x in clock.split(":"))
    return datetime(2025, 1, day, hour, minute, second)


def txn(ident, balance, amount, **other):
    row = {
        "transaction_id": ident,
        "customer_id": "c",
        "customer_dob": "1/1/90",
        "customer_gender": "F",
        "customer_location": "X",
        "customer_account_balance": balance,
        "transaction_amount_inr": amount,
        "event_time": at("00:00:00"),
    }
    row.update(other)
    return row


def frame(spark, rows, schema=DOUBLES):
    return spark.createDataFrame([tuple(r[c] for c in ORDER) for r in rows], schema)
