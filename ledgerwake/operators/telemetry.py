"""Throughput, latency and anomaly counts as queries on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The percentile of an interval is exact up to about this many alerts, and beyond it off by
# at most one rank in so many.
SKETCH = 10_000
# Size of a stored sketch, and the share of ranks it may be off by (with 99% certainty).
SKETCH_SIZE, RANK_ERROR = 800, 0.005


def throughput(transactions: DataFrame, interval: str) -> DataFrame:
    """Transactions per tumbling interval."""
    return _spread(
        transactions.groupBy(F.window("event_time", interval).alias("w")).agg(
            F.count("*").alias("n")
        ),
        "n",
    )


def anomalies_by_interval(anomalies: DataFrame, interval: str) -> DataFrame:
    """Alerts per interval and reason."""
    return _spread(
        anomalies.groupBy(F.window("event_time", interval).alias("w"), "anomaly_reason").agg(
            F.count("*").alias("n")
        ),
        "anomaly_reason",
        "n",
    )


def anomalies_by_customer(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("customer_id", "anomaly_reason").agg(F.count("*").alias("n"))


def detection_latency(alerts: DataFrame, interval: str) -> DataFrame:
    """Delay from event to alert per interval: least, mean and 95th percentile.

    `alerts` has event_time and detected_at.  Every measure, the percentile's sketch
    included, is combined before the shuffle, so a crowded interval costs one row per task.
    """
    delay = F.unix_millis("detected_at") - F.unix_millis("event_time")
    timed = alerts.select("event_time", delay.alias("delay_ms"))
    return _spread(
        timed.groupBy(F.window("event_time", interval).alias("w")).agg(
            F.count("delay_ms").alias("n"),
            F.min("delay_ms").alias("min_ms"),
            F.avg("delay_ms").alias("avg_ms"),
            F.percentile_approx("delay_ms", 0.95, SKETCH).alias("p95_ms"),
        ),
        "n",
        "min_ms",
        "avg_ms",
        "p95_ms",
    )


def latency_sketches(alerts: DataFrame, interval: str) -> DataFrame:
    """Delays per interval as a quantile sketch of bounded size, to be stored.

    Sketches of short intervals merge to those of longer ones, so that a percentile of any span
    of whole intervals needs no row of the alerts again.
    """
    delay = F.unix_millis("detected_at") - F.unix_millis("event_time")
    timed = alerts.select("event_time", delay.alias("delay_ms")).filter("delay_ms is not null")
    return _spread(
        timed.groupBy(F.window("event_time", interval).alias("w")).agg(
            F.count("*").alias("n"), F.kll_sketch_agg_bigint("delay_ms", SKETCH_SIZE).alias("sketch")
        ),
        "n",
        "sketch",
    )


def merge_latency(sketches: DataFrame, interval: str) -> DataFrame:
    """Sketches of a longer interval, which the given ones must fall into whole."""
    merged = sketches.groupBy(F.window("interval_start", interval).alias("w")).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", SKETCH_SIZE).alias("sketch")
    )
    return _spread(merged, "n", "sketch")


def latency_quantile(sketches: DataFrame, share: float = 0.95) -> DataFrame:
    """The delay at a share of the alerts, off by at most RANK_ERROR of them."""
    found = F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))
    return sketches.withColumn("delay_ms", found).drop("sketch")


def _spread(df, *columns):
    return df.select(
        F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), *columns
    )
