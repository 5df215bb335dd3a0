"""Anomaly rules as one stateless projection: no shuffle, no Python rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.fixed_values import (
    ABSOLUTE_LIMIT,
    REASON_ABSOLUTE,
    REASON_OVERDRAFT,
    REASON_RELATIVE,
    RELATIVE_SHARE,
    REPORT_DECIMAL,
)
from ledgerwake.functions.scalars import clock, content_id, measure
from ledgerwake.operators.validate import complete


@dataclass(frozen=True)
class Limits:
    relative_share: float = RELATIVE_SHARE
    absolute: float = ABSOLUTE_LIMIT


def reasons(
    amount: Column, balance: Column, limits: Limits = Limits(), stated: Column | None = None
) -> Column:
    """Array of the reasons that apply, in rule order; empty when a measure is null.

    `amount` and `balance` have null in place of NaN, so a comparison with NaN never holds.
    A balance of NaN is still a balance: `stated` says whether there is one.
    """
    stated = balance.isNotNull() if stated is None else stated
    fired = {
        REASON_RELATIVE: amount > balance * F.lit(limits.relative_share),
        # A balance must be there, though this rule only reads the amount.
        REASON_ABSOLUTE: stated & (F.abs(amount) > F.lit(limits.absolute)),
        REASON_OVERDRAFT: balance - amount < 0,
    }
    return F.array_compact(F.array(*[F.when(hit, reason) for reason, hit in fired.items()]))


def detect(
    transactions: DataFrame,
    incomplete: str = "drop",
    limits: Limits = Limits(),
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per transaction and matching rule, with the further columns named in `carry`.

    `incomplete` says what happens to rows without id, customer or location: `drop`
    leaves them out, `keep` judges them like any other but wants an event time.  A balance
    of NaN is given out as null.
    """
    if incomplete == "drop":
        rows = complete(transactions)
    elif incomplete == "keep":
        rows = transactions.filter(F.col("event_time").isNotNull())
    else:
        raise ValueError(f"incomplete must be drop or keep, not {incomplete}")
    amount = measure(transactions, "transaction_amount_inr")
    balance = measure(transactions, "customer_account_balance")
    stated = F.col("customer_account_balance").isNotNull()
    return (
        rows.withColumn("anomaly_reason", F.explode(reasons(amount, balance, limits, stated)))
        .select(
            "customer_id",
            "transaction_id",
            amount.alias("amount"),
            F.col("customer_location").alias("location"),
            "anomaly_reason",
            balance.alias("current_balance"),
            "event_time",
            *carry,
        )
    )


def alerts(anomalies: DataFrame, run_ts=None, carry: Sequence[str] = ()) -> DataFrame:
    """Stored form of anomalies: repeatable id, detection time, two decimals.

    Columns named in `carry` stay beside it, such as the event time a table is partitioned by.

    The id covers the whole event, so two different events that share a transaction
    id keep separate alerts while a replay of one event does not add a second.  It is made
    from the stored forms, decimals and whole seconds, so it does not depend on whether an
    event came as JSON or from the archive.
    """
    identity = content_id(
        F.col("transaction_id"),
        F.col("customer_id"),
        F.col("location"),
        F.col("amount").try_cast(REPORT_DECIMAL),
        F.col("current_balance").try_cast(REPORT_DECIMAL),
        F.unix_seconds(F.col("event_time").cast("timestamp")),
        F.col("anomaly_reason"),
    )
    return anomalies.select(
        identity.alias("alert_id"),
        "customer_id",
        "transaction_id",
        F.col("amount").try_cast(REPORT_DECIMAL).alias("amount"),
        "location",
        "anomaly_reason",
        clock(run_ts).alias("detected_at"),
        F.col("current_balance").try_cast(REPORT_DECIMAL).alias("current_balance"),
        *carry,
    )


def display(rows: DataFrame, label: str) -> DataFrame:
    """Rows as log lines such as `[Anomaly] {...}`, for the console sink."""
    return rows.select(
        F.concat(F.lit(f"[{label}] "), F.to_json(F.struct("*"))).alias("line")
    )
