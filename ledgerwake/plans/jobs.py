"""Whole jobs: read, transform, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerwake.functions import events
from ledgerwake.operators import clean, profile, validate
from ledgerwake.schemas import CSV_SCHEMA
from ledgerwake.session import work_folder
from ledgerwake.sinks import files as file_sink
from ledgerwake.sinks.tables import InsertIgnoreTable, UpsertTable
from ledgerwake.sources import files as file_source


def rebuild_profiles(transactions: DataFrame, table: UpsertTable, run_ts=None) -> None:
    """Profiles over all history replace the profile table."""
    table.overwrite(profile.batch_profile(transactions, run_ts))


def replay_profiles(
    transactions: DataFrame, table: UpsertTable, end, rejected_path: str, run_ts=None
) -> None:
    """Window profiles up to `end` from a bounded read, upserted into the table.

    Unlike the stream this also reports windows that are still open.  Rows that lack a
    measure, customer or time go to the rejected path.
    """
    ready, rejected = validate.split(transactions, validate.measure_checks(transactions))
    file_sink.overwrite(rejected, rejected_path)
    rows = profile.reprocess_filter(ready, end)
    table.upsert(profile.window_profile(rows, run_ts=run_ts), ["window_start"])


def load_messages(
    messages: DataFrame, table: InsertIgnoreTable, batch_path: str
) -> dict[str, int]:
    """Messages into the raw table.  Returns rows read, stored and rejected.

    The messages are decoded once, into `batch_path`; key check and load read that copy.
    What could not be read or breaks a constraint stays there under `accepted=false`.
    The counts are observed during that write.
    """
    decoded = events.decode(messages)
    checks = {
        "unreadable": F.col("decode_error").isNotNull(),
        **validate.raw_transaction_checks(decoded),
    }
    judged = validate.tag(decoded, checks).withColumn(
        "accepted", F.size("reject_reasons") == 0
    )
    seen = Observation("load")
    judged.observe(
        seen,
        F.count("*").alias("read"),
        F.count(F.when(F.col("accepted"), 1)).alias("stored"),
        F.count(F.when(~F.col("accepted"), 1)).alias("rejected"),
    ).write.mode("overwrite").partitionBy("accepted").parquet(batch_path)
    batch = messages.sparkSession.read.schema(judged.schema).parquet(batch_path)
    table.append(batch.filter("accepted"))
    return seen.get


def _fitting(spark: SparkSession, source: str, schema, rejected_path: str) -> DataFrame:
    """The rows that fit; the files are parsed once, into a staged copy."""
    rows, rejected = file_source.split_csv(
        spark, source, schema, stage=work_folder(spark, "judged-csv")
    )
    file_sink.overwrite(rejected, rejected_path)
    return rows


def clean_csv(
    spark: SparkSession, source: str, target: str, rejected_path: str,
    strategy: str = "fill_median", schema=CSV_SCHEMA,
) -> tuple[DataFrame, DataFrame]:
    """Cleans a CSV dataset.  Returns the missing-cell reports before and after.

    Further columns are kept.  Rows that do not fit the schema go to the rejected path.
    """
    rows = _fitting(spark, source, schema, rejected_path)
    cleaned = clean.clean(rows, strategy)
    file_sink.write_csv(cleaned, target)
    return clean.with_gaps(clean.null_report(rows)), clean.null_report(cleaned)


def sign_csv(
    spark: SparkSession, source: str, target: str, key: list[str], rejected_path: str,
    schema=CSV_SCHEMA, **options,
) -> None:
    """Signs the amounts of a CSV dataset; further columns are kept, as in `clean_csv`."""
    rows = _fitting(spark, source, schema, rejected_path)
    file_sink.write_csv(clean.sign_amounts(rows, key, **options), target)


def bulk_load(
    spark: SparkSession,
    source: str,
    publish: Callable[[DataFrame], None],
    rejected_path: str,
    run_ts=None,
    row_key: list[str] | None = None,
    schema=CSV_SCHEMA,
) -> int:
    """A CSV dataset as event messages, handed to `publish`.  Returns how many.

    A topic write can repeat rows after a task failure.  With `row_key` a repeated row
    keeps its id, so insert-ignore downstream removes it.  Rows that do not fit the schema
    go to the rejected path.  The files are parsed as the messages are written, without a copy,
    and once more only where a row did not fit.
    """
    unfit, sent = Observation("unfit"), Observation("sent")
    rows, rejected = file_source.split_csv(spark, source, schema, unfit=unfit)
    transactions = events.events_from_csv(rows, run_ts, row_key)
    publish(events.to_messages(transactions).observe(sent, F.count("*").alias("n")))
    file_sink.overwrite(rejected if unfit.get["n"] else rejected.limit(0), rejected_path)
    return sent.get["n"]
