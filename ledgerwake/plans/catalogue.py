"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.functions import events
from ledgerwake.functions.scalars import packed_id
from ledgerwake.operators import clean, detect, keyed, profile, summary, telemetry, validate
from ledgerwake.plans import jobs
from ledgerwake.session import brief_shuffles, use_utc, work_folder
from ledgerwake.sinks import files as file_sink
from ledgerwake.sinks import layouts
from ledgerwake.sources import files as file_source
from ledgerwake.sources import tables
from ledgerwake.streaming import pipelines
from ledgerwake.streaming.progress import BatchCounts

Query = Callable[[SparkSession, str], DataFrame]

# A moment inside the event table's month, for replays that stop before its end.
REPLAY_END = "2024-01-20 12:00:00"
RUN_TS = "2024-02-01 00:00:00"
# Event amounts are small, so the stream queries use limits that some of them exceed.
EVENT_LIMITS = detect.Limits(relative_share=0.5, absolute=200)
WRITE_ORDER = ["event_time", "l_partkey", "l_suppkey"]


def _lines(spark, sf_dir, send_places=False):
    return tables.line_transactions(spark, sf_dir, send_places)


def _gappy(spark, sf_dir, send_places=False):
    return tables.gappy_transactions(_lines(spark, sf_dir, send_places))


def _events(spark, sf_dir):
    return tables.event_transactions(tables.table(spark, sf_dir, "events"))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times without zone, the forms both engines print alike."""
    as_double = {
        f.name: F.col(f.name).cast("double")
        for f in df.schema
        if f.dataType.typeName() == "decimal"
    }
    return tables.without_zone(df.withColumns(as_double) if as_double else df)


# --- anomalies -------------------------------------------------------------------------


def anomaly_explode(spark, sf_dir):
    found = detect.detect(_lines(spark, sf_dir), "drop")
    return _plain(found)


def anomaly_keep_incomplete(spark, sf_dir):
    return _plain(detect.detect(_gappy(spark, sf_dir), "keep"))


def anomaly_drop_incomplete(spark, sf_dir):
    return _plain(detect.detect(_gappy(spark, sf_dir), "drop"))


def anomaly_rule_counts(spark, sf_dir):
    return (
        detect.detect(_lines(spark, sf_dir))
        .groupBy("anomaly_reason")
        .agg(F.count("*").alias("n"))
    )


def alert_rows(spark, sf_dir):
    return _plain(detect.alerts(detect.detect(_lines(spark, sf_dir)), RUN_TS))


# --- profiles --------------------------------------------------------------------------


def customer_location_counts(spark, sf_dir):
    return profile.location_counts(_lines(spark, sf_dir))


def top_location(spark, sf_dir):
    return profile.top_location(_lines(spark, sf_dir))


def customer_segments(spark, sf_dir):
    return _plain(profile.customer_segments(_lines(spark, sf_dir)))


def batch_profile(spark, sf_dir):
    return _plain(profile.batch_profile_by_join(_lines(spark, sf_dir), RUN_TS))


def batch_profile_single_pass(spark, sf_dir):
    return _plain(profile.batch_profile(_lines(spark, sf_dir), RUN_TS))


def batch_profile_with_gaps(spark, sf_dir):
    rows = validate.narrow(
        _gappy(spark, sf_dir),
        "decimal(12,2)",
        "customer_account_balance",
        "transaction_amount_inr",
    )
    return _plain(profile.batch_profile(rows, RUN_TS))


def incremental_profile(spark, sf_dir):
    """History in two slices, each reduced to partials, then merged."""
    rows = _lines(spark, sf_dir)
    older = F.col("customer_gender").isin("A", "B")
    merged = profile.merge_partials(
        profile.location_partials(rows.filter(older)),
        profile.location_partials(rows.filter(~older)),
    )
    return _plain(profile.profile_from_partials(merged, RUN_TS))


def window_profile_5m(spark, sf_dir):
    return _plain(profile.window_profile(_events(spark, sf_dir), "5 minutes", RUN_TS))


def window_profile_1d(spark, sf_dir):
    return _plain(profile.window_profile(_events(spark, sf_dir), "1 day", RUN_TS))


def window_profile_lines(spark, sf_dir):
    return _plain(profile.window_profile(_lines(spark, sf_dir), "1 day", RUN_TS))


def latest_profile(spark, sf_dir):
    windows = profile.window_profile(_events(spark, sf_dir), "5 minutes", RUN_TS)
    return _plain(profile.latest_profile(windows))


def reprocess_filter(spark, sf_dir):
    end = F.lit(REPLAY_END).cast("timestamp")
    rows = profile.reprocess_filter(_events(spark, sf_dir), end)
    return _plain(rows.select("transaction_id", "customer_id", "event_time"))


def reprocess_lookback(spark, sf_dir):
    """With the lower bound that a replay may switch on, here the last day."""
    end = F.lit(REPLAY_END).cast("timestamp")
    rows = profile.reprocess_filter(
        _events(spark, sf_dir), end, end - F.expr("interval 1 day")
    )
    return _plain(rows.select("transaction_id", "customer_id", "event_time"))


def reprocess_profile(spark, sf_dir):
    """From the archive, of which only the days up to the end are read."""
    table = _profile_table(spark, "reprocess_profile")
    archive = layouts.daily_archive(spark, work_folder(spark, "reprocess_raw"), parts=1)
    archive.insert(_events(spark, sf_dir))
    end = F.lit(REPLAY_END).cast("timestamp")
    jobs.replay_profiles(
        layouts.archived_until(archive, end),
        table,
        end,
        work_folder(spark, "reprocess_rejected"),
        RUN_TS,
    )
    return _plain(table.read())


# --- keyed writes ----------------------------------------------------------------------


def insert_ignore_first(spark, sf_dir):
    rows = keyed.first_per_key(_lines(spark, sf_dir), ["transaction_id"], WRITE_ORDER)
    return _plain(rows.drop("l_linenumber"))


def _raw_table(spark, purpose):
    return layouts.raw_table(spark, work_folder(spark, purpose))


def _alert_table(spark, purpose):
    return layouts.alert_table(spark, work_folder(spark, purpose))


def _profile_table(spark, purpose):
    return layouts.profile_table(spark, work_folder(spark, purpose))


def insert_ignore_table(spark, sf_dir):
    """Returned lines come in a second batch, and the first batch is sent again."""
    rows = _lines(spark, sf_dir)
    returned = F.col("transaction_amount_inr") < 0
    table = _raw_table(spark, "insert_ignore")
    table.insert(rows.filter(~returned), WRITE_ORDER[:1])
    table.insert(rows.filter(returned), WRITE_ORDER[:1])
    table.insert(rows.filter(~returned), WRITE_ORDER[:1])
    return _plain(table.read())


def _profile_slices(spark, sf_dir):
    """Latest window profiles of the days before and from the replay end."""
    rows = _events(spark, sf_dir)
    end = F.lit(REPLAY_END).cast("timestamp")
    slices = rows.filter(F.col("event_time") < end), rows.filter(F.col("event_time") >= end)
    return [
        profile.latest_profile(profile.window_profile(part, "5 minutes", RUN_TS))
        for part in slices
    ]


def upsert_merge(spark, sf_dir):
    old, new = _profile_slices(spark, sf_dir)
    return _plain(keyed.upsert(old, new, ["customer_id"], ["window_start"]))


def upsert_table(spark, sf_dir):
    old, new = _profile_slices(spark, sf_dir)
    table = _profile_table(spark, "upsert")
    table.upsert(old, ["window_start"])
    table.upsert(new, ["window_start"])
    table.upsert(new, ["window_start"])
    return _plain(table.read())


def overwrite_table(spark, sf_dir):
    table = _profile_table(spark, "overwrite")
    jobs.rebuild_profiles(_events(spark, sf_dir), table, RUN_TS)
    jobs.rebuild_profiles(_lines(spark, sf_dir), table, RUN_TS)
    return _plain(table.read())


def duplicate_ids(spark, sf_dir):
    return keyed.duplicate_keys(_lines(spark, sf_dir), ["transaction_id"])


def duplicate_total(spark, sf_dir):
    return keyed.duplicate_total(_lines(spark, sf_dir), ["transaction_id"])


# --- messages --------------------------------------------------------------------------


def json_bytes(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    value = events.encode(rows)
    return rows.select(
        "transaction_id", "l_partkey", "l_suppkey", events.message_bytes(value).alias("n_bytes")
    )


def json_messages(spark, sf_dir):
    return events.to_messages(_lines(spark, sf_dir), key="customer_id")


def json_roundtrip(spark, sf_dir):
    decoded = events.decode(events.to_messages(_lines(spark, sf_dir)))
    return _plain(events.good(decoded))


def _damaged_messages(spark, sf_dir):
    """Messages of the lines, some cut off, some with a bad or absent event time."""
    rows = _gappy(spark, sf_dir)
    gender = F.coalesce("customer_gender", F.lit("?"))
    line_no = F.col("l_linenumber")
    text = events.encode(rows)
    time = F.regexp_replace(text, '"EventTime":"[^"]*"', '"EventTime":"soon"')
    gone = F.regexp_replace(text, '"EventTime":"[^"]*"', '"EventTime":null')
    value = (
        F.when((gender == "A") & (line_no == 1), F.substring(text, 1, 40))
        .when((gender == "B") & (line_no == 2), time)
        .when((gender == "F") & (line_no == 3), gone)
        .otherwise(text)
    )
    return rows.select(value.cast("binary").alias("value"))


def decode_events(spark, sf_dir):
    return _plain(events.good(events.decode(_damaged_messages(spark, sf_dir))))


def decode_lenient(spark, sf_dir):
    """Amounts as text, balances in quotes and as objects: the fields go, the rows stay."""
    rows = _lines(spark, sf_dir)
    text, gender, line_no = events.encode(rows), F.col("customer_gender"), F.col("l_linenumber")
    amount, balance = '"TransactionAmountINR":[^,}]*', '"CustAccountBalance":([^,}]*)'
    value = (
        F.when((gender == "A") & (line_no == 1), F.regexp_replace(text, amount, '"TransactionAmountINR":"much"'))
        .when((gender == "B") & (line_no == 2), F.regexp_replace(text, balance, '"CustAccountBalance":"$1"'))
        .when((gender == "F") & (line_no == 3), F.regexp_replace(text, balance, '"CustAccountBalance":{"is":$1}'))
        .when((gender == "H") & (line_no == 4), F.substring(text, 1, 40))
        .otherwise(text)
    )
    return _plain(events.good(events.decode_lenient(rows.select(value.alias("value")))))


def decode_quarantine(spark, sf_dir):
    aside = events.quarantine(events.decode(_damaged_messages(spark, sf_dir)))
    return aside.groupBy("decode_error").agg(F.count("*").alias("n"))


def load_counts(spark, sf_dir):
    """Bulk load of the deduplicated lines; rows read, stored and rejected."""
    rows = keyed.first_per_key(_lines(spark, sf_dir), ["transaction_id"], WRITE_ORDER)
    folder = work_folder(spark, "load")
    table = layouts.raw_table(spark, f"{folder}/raw")
    counts = jobs.load_messages(events.to_messages(rows), table, f"{folder}/batch")
    stored = table.read().agg(F.count("*").alias("n_rows"))
    return stored.select(
        *[F.lit(n).cast("bigint").alias(f"n_{stage}") for stage, n in counts.items()], "n_rows"
    )


# --- validation ------------------------------------------------------------------------


def _suspect(spark, sf_dir):
    """Lines with gaps, and amounts scaled so that some leave the stored decimal."""
    rows = _gappy(spark, sf_dir)
    inflated = F.when(
        F.col("customer_location") == "NATION_1", F.col("transaction_amount_inr") * 1000000
    ).otherwise(F.col("transaction_amount_inr"))
    return rows.withColumn("transaction_amount_inr", inflated)


def validate_rejected(spark, sf_dir):
    rows = _suspect(spark, sf_dir)
    _, rejected = validate.split(rows, validate.raw_transaction_checks(rows))
    return rejected.select(
        "transaction_id",
        "l_partkey",
        "l_suppkey",
        F.array_join("reject_reasons", ",").alias("reject_reasons"),
    )


def validate_valid(spark, sf_dir):
    rows = _suspect(spark, sf_dir)
    valid, _ = validate.split(rows, validate.raw_transaction_checks(rows))
    stored = validate.narrow(
        valid, "decimal(12,2)", "customer_account_balance", "transaction_amount_inr"
    )
    return _plain(stored.drop("l_linenumber"))


def validate_counts(spark, sf_dir):
    rows = _suspect(spark, sf_dir)
    return validate.reject_counts(rows, validate.raw_transaction_checks(rows))


# --- cleaning --------------------------------------------------------------------------


def _dataset(spark, sf_dir, send_places=False):
    """The lines with gaps under the CSV dataset's column names, plus a row key."""
    return _gappy(spark, sf_dir, send_places).select(
        "transaction_id",
        "l_partkey",
        "l_suppkey",
        F.col("customer_id").alias("CustomerID"),
        F.col("customer_dob").alias("CustomerDOB"),
        F.col("customer_gender").alias("CustGender"),
        F.col("customer_location").alias("CustLocation"),
        F.col("customer_account_balance").alias("CustAccountBalance"),
        F.col("transaction_amount_inr").alias("TransactionAmount (INR)"),
    )


def _named(df):
    return df.withColumnRenamed("TransactionAmount (INR)", "amount")


def null_report(spark, sf_dir):
    return clean.null_report(_dataset(spark, sf_dir))


def null_report_gaps(spark, sf_dir):
    return clean.with_gaps(clean.null_report(_dataset(spark, sf_dir)))


def clean_drop(spark, sf_dir):
    return _named(clean.clean(_dataset(spark, sf_dir), "drop"))


def clean_mean(spark, sf_dir):
    filled = _named(clean.clean(_dataset(spark, sf_dir), "fill_mean"))
    return filled.withColumns(
        {c: F.round(c, 4) for c in ("CustAccountBalance", "amount")}
    )


def clean_median(spark, sf_dir):
    return _named(clean.clean(_dataset(spark, sf_dir), "fill_median"))


def clean_mode(spark, sf_dir):
    return _named(clean.clean(_dataset(spark, sf_dir), "fill_mode"))


def clean_custom(spark, sf_dir):
    return _named(clean.clean(_dataset(spark, sf_dir), "custom"))


def column_modes(spark, sf_dir):
    return _named(clean.column_modes(_dataset(spark, sf_dir)))


def column_summary(spark, sf_dir):
    found = summary.column_summary(
        _gappy(spark, sf_dir), ["transaction_amount_inr", "customer_account_balance"]
    )
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


def sign_by_hash(spark, sf_dir):
    signed = clean.sign_amounts(
        _dataset(spark, sf_dir), ["transaction_id", "l_partkey", "l_suppkey"]
    )
    return _named(signed).select("transaction_id", "l_partkey", "l_suppkey", "amount")


def row_counts(spark, sf_dir):
    rows = _suspect(spark, sf_dir)
    judged = validate.tag(rows, validate.raw_transaction_checks(rows))
    fits = F.size("reject_reasons") == 0
    return summary.row_counts(judged, read=F.lit(True), valid=fits, rejected=~fits)


# --- CSV jobs --------------------------------------------------------------------------


def _csv_dataset(spark, sf_dir, purpose, send_places=False, **options):
    folder = work_folder(spark, purpose)
    rows = _dataset(spark, sf_dir, send_places)
    file_sink.write_csv(rows, f"{folder}/in", **options)
    return folder, rows.schema


def csv_roundtrip(spark, sf_dir):
    folder, schema = _csv_dataset(spark, sf_dir, "csv")
    return _named(file_source.read_csv(spark, f"{folder}/in", schema))


def csv_inferred(spark, sf_dir):
    folder, _ = _csv_dataset(spark, sf_dir, "csv-inferred")
    return _named(file_source.read_csv(spark, f"{folder}/in"))


def csv_reordered(spark, sf_dir):
    """Columns in another order with two further ones between; all are found by name."""
    folder, rows = work_folder(spark, "csv-reordered"), _dataset(spark, sf_dir)
    moved = rows.select(
        F.lit("kept").alias("note"),
        *reversed(rows.columns),
        (F.col("l_partkey") + 1).alias("next_part"),
    )
    file_sink.write_csv(moved, f"{folder}/in")
    return _named(file_source.read_csv(spark, f"{folder}/in", rows.schema))


def csv_rejects(spark, sf_dir):
    """How many lines fit, have a cell too many, or text in a number column."""
    folder, rows = work_folder(spark, "csv-rejects"), _named(_dataset(spark, sf_dir))
    kind = F.col("l_suppkey") % 10
    amount = F.coalesce(F.col("amount").cast("string"), F.lit(""))
    line = F.concat(
        "transaction_id",
        F.lit(","),
        F.when(kind == 0, F.concat(amount, F.lit(",more")))
        .when(kind == 1, "unknown amount")
        .otherwise(amount),
    )
    rows.select(line).write.text(f"{folder}/in")
    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("amount", T.DoubleType())]
    )
    good, rejected = file_source.split_csv(spark, f"{folder}/in", schema, header=False)
    outcomes = good.select(F.lit("fits").alias("outcome")).unionByName(
        rejected.select(F.col("reject_reasons")[0].alias("outcome"))
    )
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def csv_stream(spark, sf_dir):
    """Files with their columns in three orders, one micro-batch each; some amounts are text."""
    folder, rows = work_folder(spark, "csv-stream"), _named(_dataset(spark, sf_dir))
    files = tables.csv_files(spark, sf_dir)
    amount = F.when(F.col("l_suppkey") % 10 == 1, "unknown").otherwise(F.col("amount").cast("string"))
    cells = rows.select(
        F.col("transaction_id").alias("id"), amount.alias("amount"), F.lit("more").alias("note"),
        (F.col("l_partkey") % 3).alias("k"),
    )
    for k, names in enumerate((["id", "amount"], ["amount", "id"], ["note", "amount", "id"])):
        ordered = cells.filter(F.col("k") == k).select(names)
        file_sink.write_csv(file_source.dealt(ordered, files), f"{folder}/in", "append")
    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("amount", T.DoubleType())]
    )
    pipelines.csv_stream(
        file_source.stream_csv_paths(spark, f"{folder}/in", files),
        schema,
        lambda good, batch_id: good.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}"),
        f"{folder}/state",
        f"{folder}/rejected",
    ).awaitTermination()
    good = spark.read.schema(schema).parquet(f"{folder}/out")
    aside = spark.read.schema("reject_reasons array<string>, line string").parquet(f"{folder}/rejected")
    again = F.get_json_object("line", "$.id")
    return good.select("id", "amount", F.lit("fits").alias("outcome")).unionByName(
        aside.select(again.alias("id"), F.lit(None).cast("double").alias("amount"), F.col("reject_reasons")[0].alias("outcome"))
    )


def csv_clean_job(spark, sf_dir):
    folder, schema = _csv_dataset(spark, sf_dir, "csv-clean")
    jobs.clean_csv(spark, f"{folder}/in", f"{folder}/out", f"{folder}/rejected", "custom", schema)
    return _named(file_source.read_csv(spark, f"{folder}/out", schema))


def csv_sign_job(spark, sf_dir):
    folder, schema = _csv_dataset(spark, sf_dir, "csv-sign")
    key = ["transaction_id", "l_partkey", "l_suppkey"]
    jobs.sign_csv(spark, f"{folder}/in", f"{folder}/out", key, f"{folder}/rejected", schema)
    signed = _named(file_source.read_csv(spark, f"{folder}/out", schema))
    return signed.select(*key, "amount")


def bulk_load_events(spark, sf_dir):
    """CSV to event messages and back to transactions, without the generated ids.

    Nothing stays on disk longer than it is needed: the shuffles of the joins go once the CSV is
    written, the CSV goes once it is loaded.
    """
    with brief_shuffles(spark):
        folder, schema = _csv_dataset(spark, sf_dir, "bulk-load", True, **file_sink.SMALL)
    jobs.bulk_load(
        spark,
        f"{folder}/in",
        lambda messages: messages.write.options(**file_sink.SMALL).text(f"{folder}/topic"),
        f"{folder}/rejected",
        RUN_TS,
        ["transaction_id", "l_partkey", "l_suppkey"],
        schema,
    )
    file_sink.remove(spark, f"{folder}/in")
    messages = file_source.read_messages(spark, f"{folder}/topic")
    loaded, keys = events.good(events.decode(messages)), ["customer_id", "customer_location", "event_time"]
    # Nearly every id is another one, so rows are dealt out as they are: counting them in the
    # task that reads them would make none fewer and fill its memory.
    ids = loaded.select(
        *keys,
        packed_id(F.col("transaction_id")).alias("id"),
        F.when(F.col("transaction_amount_inr").isNotNull(), 1).alias("has_amount"),
    ).repartition(*keys, "id")
    return _plain(
        ids.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.count("has_amount").alias("n_amounts"),
            F.count_distinct("id").alias("n_ids"),
        )
    )


# --- streams ---------------------------------------------------------------------------


def _stream(spark, sf_dir):
    return tables.event_transactions(tables.stream_events(spark, sf_dir))


def stream_anomalies(spark, sf_dir):
    folder = work_folder(spark, "stream-anomalies")
    found = pipelines.anomaly_stream(_stream(spark, sf_dir), "keep", EVENT_LIMITS, RUN_TS)
    pipelines.start(
        found, "stream-anomalies", f"{folder}/state", path=f"{folder}/out"
    ).awaitTermination()
    return _plain(spark.read.schema(found.schema).parquet(f"{folder}/out"))


def stream_window_profile(spark, sf_dir):
    folder = work_folder(spark, "stream-profile")
    profiles = pipelines.profile_stream(
        _stream(spark, sf_dir), F.lit("2100-01-01").cast("timestamp"), run_ts=RUN_TS
    )
    pipelines.start(
        profiles, "stream-profile", f"{folder}/state", path=f"{folder}/out"
    ).awaitTermination()
    return _plain(spark.read.schema(profiles.schema).parquet(f"{folder}/out"))


def stream_first_rows(spark, sf_dir):
    folder = work_folder(spark, "stream-first")
    rows = pipelines.first_rows(_stream(spark, sf_dir))
    pipelines.start(
        rows, "stream-first", f"{folder}/state", path=f"{folder}/out"
    ).awaitTermination()
    return _plain(spark.read.schema(rows.schema).parquet(f"{folder}/out"))


def _run_speed_layer(spark, sf_dir, purpose):
    folder = work_folder(spark, purpose)
    messages = events.to_messages(_stream(spark, sf_dir))
    alerts = layouts.alert_table(spark, f"{folder}/alerts")
    archive = layouts.raw_table(spark, f"{folder}/archive")
    pipelines.speed_layer(
        events.decode(messages),
        alerts,
        archive,
        f"{folder}/state",
        f"{folder}/rejected",
        limits=EVENT_LIMITS,
    ).awaitTermination()
    return alerts, archive


def speed_layer_archive(spark, sf_dir):
    _, archive = _run_speed_layer(spark, sf_dir, "speed-archive")
    return _plain(archive.read())


def speed_layer_alerts(spark, sf_dir):
    alerts, _ = _run_speed_layer(spark, sf_dir, "speed-alerts")
    return _plain(alerts.read().drop("detected_at"))


def alert_replay(spark, sf_dir):
    """Alerts from JSON, then again from the archived rows, which must add none."""
    alerts, archive = _run_speed_layer(spark, sf_dir, "alert-replay")
    again = detect.detect(archive.read(), "drop", EVENT_LIMITS)
    alerts.insert(detect.alerts(again, carry=["event_time"]))
    return _plain(alerts.read().drop("detected_at"))


def single_pipeline_realtime(spark, sf_dir):
    table = _alert_table(spark, "pipeline-alerts")
    for query in pipelines.single_pipeline(
        _stream(spark, sf_dir),
        "realtime",
        work_folder(spark, "pipeline-state"),
        work_folder(spark, "pipeline-rejected"),
        alerts=table,
        limits=EVENT_LIMITS,
    ):
        query.awaitTermination()
    return _plain(table.read().drop("detected_at"))


def single_pipeline_reprocess(spark, sf_dir):
    table = _profile_table(spark, "pipeline-profiles")
    for query in pipelines.single_pipeline(
        _stream(spark, sf_dir),
        "reprocess",
        work_folder(spark, "pipeline-state"),
        work_folder(spark, "pipeline-rejected"),
        profiles=table,
        end=F.lit(REPLAY_END).cast("timestamp"),
    ):
        query.awaitTermination()
    return _plain(table.read().drop("last_updated"))


def _sent(spark, sf_dir, folder, broken=True):
    """A topic of four slices, one micro-batch each; the second also has cut-off messages."""
    files = tables.slice_files(spark, sf_dir)
    for number, rows in enumerate(tables.sent_slices(spark, sf_dir)):
        messages = events.to_messages(rows)
        if broken and number == 1:
            some = rows.filter(F.col("transaction_id").cast("long") % 10 == 3)
            cut = events.to_messages(some).select(F.substring("value", 1, 40).alias("value"))
            messages = messages.unionByName(cut)
        file_source.add_slice(messages, f"{folder}/topic", files)
    return events.decode(file_source.stream_messages(spark, f"{folder}/topic", files))


def stream_late_counts(spark, sf_dir):
    """Rows read and rows that came too late, by micro-batch, from the query's own progress."""
    folder = work_folder(spark, "late-counts")
    rows = pipelines.first_rows(events.good(_sent(spark, sf_dir, folder, broken=False)))
    name = f"late-counts-{folder[-8:]}"
    with BatchCounts(spark, name, f"{folder}/counts") as counts:
        pipelines.start(rows, name, f"{folder}/state", path=f"{folder}/out").awaitTermination()
    return counts.read()


def stream_balance(spark, sf_dir):
    """Offered rows are stored, ignored for a known id, or rejected; unreadable messages are extra."""
    folder = work_folder(spark, "balance")
    archive = layouts.raw_table(spark, f"{folder}/archive")
    pipelines.speed_layer(
        _sent(spark, sf_dir, folder),
        layouts.alert_table(spark, f"{folder}/alerts"),
        archive,
        f"{folder}/state",
        f"{folder}/rejected",
        limits=EVENT_LIMITS,
        balance_path=f"{folder}/balance",
    ).awaitTermination()
    notes = spark.read.schema(f"{pipelines.BALANCE}, batch int").parquet(f"{folder}/balance")
    aside = spark.read.schema("decode_error string, batch int").parquet(f"{folder}/rejected/messages")
    unread = aside.groupBy("batch").agg(F.count("*").alias("n_unreadable"))
    return notes.join(unread, "batch", "left").select(
        F.col("batch").alias("batch_id"),
        F.col("offered").alias("n_offered"),
        F.col("added").alias("n_stored"),
        (F.col("offered") - F.col("added") - F.col("rejected")).alias("n_ignored"),
        F.col("rejected").alias("n_rejected"),
        F.coalesce("n_unreadable", F.lit(0)).cast("long").alias("n_unreadable"),
    )


def stream_recovery(spark, sf_dir):
    """The speed layer, ended in its third batch between two sinks and started again."""
    folder = work_folder(spark, "recovery")
    alerts = layouts.alert_table(spark, f"{folder}/alerts")
    archive = layouts.raw_table(spark, f"{folder}/archive")
    decoded, broken = _sent(spark, sf_dir, folder), []

    def break_once(batch, batch_id):
        if batch_id == 2 and not broken:
            broken.append(batch_id)
            raise RuntimeError("ended between two sinks")

    def run():
        pipelines.speed_layer(
            decoded, alerts, archive, f"{folder}/state", f"{folder}/rejected",
            limits=EVENT_LIMITS, more_steps=[break_once],
        ).awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    aside = spark.read.schema("decode_error string").parquet(f"{folder}/rejected/messages")
    sides = [
        ("alerts", alerts.read(), "alert_id", F.sum("amount")),
        ("archive", archive.read(), "transaction_id", F.sum("transaction_amount_inr")),
        ("unreadable", aside, "decode_error", F.lit(None)),
    ]
    parts = [
        df.agg(
            F.lit(name).alias("stored_in"),
            F.count("*").alias("n_rows"),
            F.count_distinct(key).alias("n_keys"),
            total.cast("double").alias("amount"),
            F.lit(len(broken)).alias("n_failures"),
        )
        for name, df, key, total in sides
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def live_history_profile(spark, sf_dir):
    """Profiles over all history as they stand after each micro-batch."""
    folder = work_folder(spark, "live-history")
    profiles = layouts.profile_table(spark, f"{folder}/profiles")

    def picture(batch, batch_id):
        profiles.read().write.mode("overwrite").parquet(f"{folder}/pictures/batch_id={batch_id}")

    pipelines.live_history(
        events.good(_sent(spark, sf_dir, folder)),
        layouts.totals_table(spark, f"{folder}/totals"),
        profiles,
        f"{folder}/state",
        f"{folder}/rejected",
        RUN_TS,
        more_steps=[picture],
    ).awaitTermination()
    kind = profiles.schema.simpleString()[7:-1].replace(":", " ")
    return _plain(spark.read.schema(f"{kind}, batch_id int").parquet(f"{folder}/pictures"))


def live_latency(spark, sf_dir):
    """Alerts and raw rows as two streams of three slices each; the last day is still open."""
    folder, files = work_folder(spark, "live-latency"), tables.slice_files(spark, sf_dir)
    number = F.col("transaction_id").cast("long")
    for rows in tables.sent_slices(spark, sf_dir, again=False)[:3]:
        delay = F.make_dt_interval(secs=number % 97 + 1)
        timed = rows.withColumn("detected_at", F.col("event_time") + delay)
        found = detect.detect(timed, limits=EVENT_LIMITS, carry=["detected_at"])
        for side, name in ((rows, "rows"), (found, "alerts")):
            file_source.dealt(side, files).write.mode("append").parquet(f"{folder}/{name}")
    streams = [
        spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
        .option("maxFilesPerTrigger", files)
        .parquet(f"{folder}/{name}")
        for name in ("alerts", "rows")
    ]
    latency = pipelines.live_latency(*streams, "1 day")
    pipelines.start(latency, "live-latency", f"{folder}/state", path=f"{folder}/out").awaitTermination()
    return _plain(spark.read.schema(latency.schema).parquet(f"{folder}/out"))


# --- telemetry -------------------------------------------------------------------------


def throughput_1h(spark, sf_dir):
    return _plain(telemetry.throughput(_events(spark, sf_dir), "1 hour"))


def anomalies_by_hour(spark, sf_dir):
    found = detect.detect(_events(spark, sf_dir), limits=EVENT_LIMITS)
    return _plain(telemetry.anomalies_by_interval(found, "1 hour"))


def anomalies_by_customer(spark, sf_dir):
    return telemetry.anomalies_by_customer(detect.detect(_lines(spark, sf_dir)))


def _late_alerts(spark, sf_dir):
    """Alerts come some seconds after the event, as the part of the line says."""
    archive = keyed.first_per_key(_lines(spark, sf_dir), ["transaction_id"], WRITE_ORDER)
    archive = archive.withColumn("event_time", F.col("event_time").cast("timestamp"))
    delay = F.make_dt_interval(secs=F.col("l_partkey") % 97 + 1)
    late = archive.withColumn("detected_at", F.col("event_time") + delay)
    return detect.detect(late, carry=["detected_at"])


def detection_latency(spark, sf_dir):
    return _plain(telemetry.detection_latency(_late_alerts(spark, sf_dir), "1 day"))


def latency_from_sketches(spark, sf_dir):
    """Monthly 95th percentile from stored daily sketches, and whether its true rank is in bounds."""
    folder, alerts = work_folder(spark, "sketches"), _late_alerts(spark, sf_dir)
    daily = telemetry.latency_sketches(alerts, "1 day")
    daily.write.parquet(folder)
    stored = spark.read.schema(daily.schema).parquet(folder)
    longer = telemetry.latency_quantile(telemetry.merge_latency(stored, "28 days")).select(
        "interval_start", "interval_end", "n", F.col("delay_ms").alias("p95_ms")
    )
    delay = F.unix_millis("detected_at") - F.unix_millis("event_time")
    span = F.window("event_time", "28 days")
    timed = alerts.select(span["start"].alias("interval_start"), delay.alias("delay_ms"))
    by_delay = timed.groupBy("interval_start", "delay_ms").agg(F.count("*").alias("m"))
    ranked = by_delay.join(longer, "interval_start").groupBy("interval_start", "interval_end", "n").agg(
        F.sum(F.when(F.col("delay_ms") < F.col("p95_ms"), F.col("m")).otherwise(0)).alias("under"),
        F.sum(F.when(F.col("delay_ms") <= F.col("p95_ms"), F.col("m")).otherwise(0)).alias("upto"),
    )
    low, high = ((0.95 + s * telemetry.RANK_ERROR) * F.col("n") for s in (-1, 1))
    within = (F.col("under") <= high) & (F.col("upto") >= low)
    return _plain(ranked.select("interval_start", "interval_end", "n", within.alias("within_bounds")))


QUERIES: tuple[Query, ...] = (
    anomaly_explode,
    anomaly_keep_incomplete,
    anomaly_drop_incomplete,
    anomaly_rule_counts,
    alert_rows,
    customer_location_counts,
    top_location,
    customer_segments,
    batch_profile,
    batch_profile_single_pass,
    batch_profile_with_gaps,
    incremental_profile,
    window_profile_5m,
    window_profile_1d,
    window_profile_lines,
    latest_profile,
    reprocess_filter,
    reprocess_lookback,
    reprocess_profile,
    insert_ignore_first,
    insert_ignore_table,
    upsert_merge,
    upsert_table,
    overwrite_table,
    duplicate_ids,
    duplicate_total,
    json_bytes,
    json_messages,
    json_roundtrip,
    decode_events,
    decode_lenient,
    decode_quarantine,
    load_counts,
    validate_rejected,
    validate_valid,
    validate_counts,
    null_report,
    null_report_gaps,
    clean_drop,
    clean_mean,
    clean_median,
    clean_mode,
    clean_custom,
    column_modes,
    column_summary,
    sign_by_hash,
    row_counts,
    csv_roundtrip,
    csv_inferred,
    csv_reordered,
    csv_rejects,
    csv_stream,
    csv_clean_job,
    csv_sign_job,
    bulk_load_events,
    stream_anomalies,
    stream_window_profile,
    stream_first_rows,
    speed_layer_archive,
    speed_layer_alerts,
    alert_replay,
    single_pipeline_realtime,
    single_pipeline_reprocess,
    stream_late_counts,
    stream_balance,
    stream_recovery,
    live_history_profile,
    live_latency,
    throughput_1h,
    anomalies_by_hour,
    anomalies_by_customer,
    detection_latency,
    latency_from_sketches,
)


def catalogue() -> dict[str, Query]:
    return {query.__name__: _in_utc(query) for query in QUERIES}


def _in_utc(query: Query) -> Query:
    return lambda spark, sf_dir: query(use_utc(spark), sf_dir)
