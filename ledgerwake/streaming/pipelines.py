"""Streaming jobs.  Each applies the batch operators to a streaming frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwake.fixed_values import PROFILE_WINDOW, RAW_DECIMAL, REPORT_DECIMAL, WATERMARK_DELAY
from ledgerwake.functions import events
from ledgerwake.operators import detect, profile, telemetry, validate
from ledgerwake.sinks.tables import PART, InsertIgnoreTable, UpsertTable
from ledgerwake.sources import files as source_files

# Takes a micro-batch and its number, which a restarted query uses again.
Step = Callable[[DataFrame, int], None]


def start(
    stream: DataFrame,
    name: str,
    checkpoint: str,
    path: str | None = None,
    steps: Sequence[Step] = (),
    trigger: dict | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Starts a query that appends to Parquet files or hands each batch to all steps.

    `name` and `checkpoint` are the query's lasting identity.  The default trigger works
    off what is there in as many batches as the source limits ask for, then stops.
    """
    writer = (
        stream.writeStream.queryName(name)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    if path:
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(fan_out(*steps)).start()


def fan_out(*steps: Step) -> Callable[[DataFrame, int], None]:
    """One micro-batch for several sinks.  It is read once and kept for all of them.

    Counting it first tells Spark its true size, so that joins with a large table can
    broadcast a small batch and leave the table where it is.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            kept.count()
            for step in steps:
                step(kept, batch_id)
        finally:
            kept.unpersist()

    return handle


def with_event_time(transactions: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    return transactions.withWatermark("event_time", delay)


def anomaly_stream(
    transactions: DataFrame,
    incomplete: str = "keep",
    limits: detect.Limits = detect.Limits(),
    run_ts=None,
) -> DataFrame:
    """Stored alerts of a stream.  Stateless, so no watermark is needed."""
    return detect.alerts(detect.detect(transactions, incomplete, limits), run_ts)


def profile_stream(
    transactions: DataFrame, end, width: str = PROFILE_WINDOW, delay: str = WATERMARK_DELAY,
    run_ts=None,
) -> DataFrame:
    """Window profiles up to `end`, each given out once its window has closed.

    The watermark comes before the filter, so rows behind `end` still move it on.
    """
    timed = with_event_time(transactions, delay)
    return profile.window_profile(profile.reprocess_filter(timed, end), width, run_ts)


def csv_stream(
    files: DataFrame,
    schema,
    step: Step,
    checkpoint: str,
    rejected_path: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """CSV files as they arrive, `files` being a stream of paths (`stream_csv_paths`).

    Each file's header is checked by itself, so files may have their columns in any order.  The
    step gets the rows that fit, in the columns of `schema`; others are set aside as JSON with
    file and reasons, and so is a file whose header lacks a column or repeats one.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # At most as many paths as the source takes for a micro-batch.
        paths = sorted(r.file for r in batch.distinct().collect())
        good, aside = [], []
        for path in paths:
            try:
                rows, rejected = source_files.split_csv(spark, path, schema)
            except ValueError as problem:
                aside.append(spark.createDataFrame([(path, [str(problem)], None)], _ASIDE))
                continue
            good.append(rows.select(*[F.col(f"`{n}`") for n in schema.names]))
            line = F.to_json(F.struct("*"))
            aside.append(rejected.select(F.lit(path).alias("file"), "reject_reasons", line.alias("line")))
        set_aside(reduce(DataFrame.unionAll, aside), rejected_path, batch_id)
        if good:
            step(reduce(DataFrame.unionAll, good), batch_id)

    return start(files, "csv-files", checkpoint, steps=[handle], trigger=trigger)


_ASIDE = "file string, reject_reasons array<string>, line string"


def first_rows(transactions: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    """Repeats of a transaction id dropped within the watermark, with bounded state."""
    return with_event_time(transactions, delay).dropDuplicatesWithinWatermark(
        ["transaction_id"]
    )


def set_aside(rejected: DataFrame, path: str, batch_id: int) -> None:
    """Rejected rows of one micro-batch; a repeated batch replaces its own rows."""
    rejected.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def untimed_path(rejected_path: str) -> str:
    return f"{rejected_path.rstrip('/')}-untimed"


def quarantine_to(path: str) -> Step:
    """Step that keeps the records of a decoded batch that could not be read."""
    return lambda batch, batch_id: set_aside(events.quarantine(batch), path, batch_id)


def on_good(step: Step, need_time: bool = True) -> Step:
    """Runs a step on the readable records of a decoded batch."""
    return lambda batch, batch_id: step(events.good(batch, need_time), batch_id)


def live_latency(
    alerts: DataFrame,
    transactions: DataFrame,
    interval: str,
    longest: str = "10 minutes",
    delay: str = WATERMARK_DELAY,
) -> DataFrame:
    """Delay from event to alert per closed interval, of two streams joined on the transaction.

    `alerts` has transaction_id and detected_at.  An alert is looked for no longer than `longest` after
    its event, so each side's rows leave the state once the watermark has passed them by that.
    """
    found = alerts.select("transaction_id", "detected_at").withWatermark("detected_at", delay)
    rows = transactions.select(F.col("transaction_id").alias("raw_id"), "event_time")
    rows = with_event_time(rows, delay)
    met = found.join(
        rows,
        F.expr(
            "transaction_id = raw_id AND detected_at >= event_time"
            f" AND detected_at <= event_time + INTERVAL {longest}"
        ),
    )
    return telemetry.detection_latency(met, interval)


BALANCE = "offered long, added long, rejected long"


def archive_to(
    table: InsertIgnoreTable, rejected_path: str,
    order_by: Sequence[str] = ("event_time",),
    balance_path: str | None = None,
) -> Step:
    """Step that stores valid raw rows once per id and sets the others aside.

    With `balance_path` it notes there how many rows of each batch were offered, added and
    rejected; the rest was ignored, for its id was known.  A batch that is repeated after its rows
    were stored adds none and keeps its note; if it broke off before the note, they count as ignored.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = validate.split(batch, validate.raw_transaction_checks(batch))
        added = table.insert(valid, order_by)
        set_aside(rejected, rejected_path, batch_id)
        if balance_path:
            row = [(batch.count(), added, rejected.count())]
            note = batch.sparkSession.createDataFrame(row, BALANCE).coalesce(1)
            note.write.mode("overwrite" if added else "ignore").parquet(f"{balance_path}/batch={batch_id}")

    return step


def alerts_to(
    table: InsertIgnoreTable,
    rejected_path: str,
    incomplete: str = "drop",
    limits: detect.Limits = detect.Limits(),
    run_ts=None,
) -> Step:
    """Step that stores the alerts of a batch; a repeated batch adds none.

    Alerts the table has no room for are set aside.  Where incomplete rows are kept, only
    the size of the amounts is checked, and rows without event time, which are not judged
    then, are set aside in a folder of their own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if incomplete == "keep":
            _, untimed = validate.split(batch, validate.not_null(batch, "event_time"))
            set_aside(untimed, untimed_path(rejected_path), batch_id)
        found = detect.detect(batch, incomplete, limits)
        if incomplete == "drop":
            checks = validate.alert_checks(found)
        else:
            checks = validate.fits(found, REPORT_DECIMAL, "amount", "current_balance")
        valid, rejected = validate.split(found, checks)
        table.insert(detect.alerts(valid, run_ts, ["event_time"]))
        set_aside(rejected, rejected_path, batch_id)

    return step


def profiles_to(table: UpsertTable) -> Step:
    """Step that replaces the profile of each customer by its newest window."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, ["window_start"])

    return step


def history_to(totals: UpsertTable, profiles: UpsertTable, run_ts=None) -> Step:
    """Step that replaces changed totals, and the profiles of the customers they belong to.

    It takes the totals a streaming aggregation gives out after each batch.  Repeating a batch
    writes the same totals again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(
            "customer_id",
            F.col("customer_location").isNotNull().alias("located"),
            F.coalesce("customer_location", F.lit("")).alias("place"),
            "visits",
            "amount_sum",
            "amount_cnt",
            "balance_max",
        )
        totals.upsert(changed)
        customers = totals.placed(changed).select(PART, "customer_id").distinct()
        kept = totals.partitions([r[0] for r in customers.select(PART).distinct().collect()])
        whole = kept.join(customers, [PART, "customer_id"], "left_semi")
        whole = whole.withColumn("customer_location", F.when(F.col("located"), F.col("place")))
        profiles.upsert(profile.profile_from_partials(whole, run_ts))

    return step


def live_history(
    transactions: DataFrame,
    totals: UpsertTable,
    profiles: UpsertTable,
    checkpoint: str,
    rejected_path: str,
    run_ts=None,
    trigger: dict | None = None,
    more_steps: Sequence[Step] = (),
) -> StreamingQuery:
    """Profiles over all history, kept up to date: after each batch only changed customers are written.

    Totals per customer and location are the state of the stream, so a restart counts nothing
    twice.  Rows without a customer have no profile to change; they are set aside as totals.
    """
    rows = validate.narrow(
        transactions, RAW_DECIMAL, "customer_account_balance", "transaction_amount_inr"
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        known, unknown = validate.split(batch, validate.not_null(batch, "customer_id"))
        set_aside(unknown, rejected_path, batch_id)
        history_to(totals, profiles, run_ts)(known, batch_id)

    return start(
        profile.location_partials(rows),
        "live-history",
        checkpoint,
        steps=[step, *more_steps],
        trigger=trigger,
        output_mode="update",
    )


def speed_layer(
    decoded: DataFrame,
    alerts: InsertIgnoreTable,
    archive: InsertIgnoreTable,
    checkpoint: str,
    rejected_path: str,
    trigger: dict | None = None,
    limits: detect.Limits = detect.Limits(),
    balance_path: str | None = None,
    more_steps: Sequence[Step] = (),
) -> StreamingQuery:
    """Detection, raw archive and quarantine from one read of decoded messages.

    Records without event time are still judged; the archive rejects them.  Further steps come
    after detection and before the archive.
    """
    return start(
        decoded,
        "speed-layer",
        checkpoint,
        steps=[
            on_good(
                alerts_to(alerts, f"{rejected_path}/alerts", "drop", limits),
                need_time=False,
            ),
            *more_steps,
            on_good(
                archive_to(archive, f"{rejected_path}/rows", balance_path=balance_path),
                need_time=False,
            ),
            quarantine_to(f"{rejected_path}/messages"),
        ],
        trigger=trigger,
    )


def single_pipeline(
    transactions: DataFrame,
    mode: str,
    checkpoint: str,
    rejected_path: str,
    alerts: InsertIgnoreTable | None = None,
    profiles: UpsertTable | None = None,
    end=None,
    trigger: dict | None = None,
    limits: detect.Limits = detect.Limits(),
) -> list[StreamingQuery]:
    """One job, two modes: `realtime` detection or `reprocess` of profiles.

    Returns the queries that were started.  A replay has a second one, which writes the rows
    that lack what a profile needs to the rejected path; its own checkpoint lies beside the
    first.

    For a replay give a fresh checkpoint and a source that starts at the earliest record.
    It takes rows up to `end`, by default the moment it is started; of the rejected rows, those
    up to `end` and those without a time.
    """
    if mode == "realtime":
        steps = [alerts_to(alerts, rejected_path, "keep", limits)]
        return [start(transactions, "realtime-detection", checkpoint, steps=steps, trigger=trigger)]
    if mode == "reprocess":
        until = F.lit(datetime.now(timezone.utc)) if end is None else end
        ready, rejected = validate.split(transactions, validate.measure_checks(transactions))
        rejected = rejected.filter(F.col("event_time").isNull() | (F.col("event_time") <= until))
        return [
            start(
                profile_stream(ready, until),
                "reprocess-profiles",
                checkpoint,
                steps=[profiles_to(profiles)],
                trigger=trigger,
            ),
            start(
                rejected,
                "reprocess-rejected",
                f"{checkpoint}-rejected",
                path=rejected_path,
                trigger=trigger,
            ),
        ]
    raise ValueError(f"mode must be realtime or reprocess, not {mode}")
