"""Transaction events as JSON: decoding with quarantine, and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.fixed_values import (
    CSV_TO_EVENT,
    EVENT_TIME_FORMAT,
    EVENT_TO_COLUMN,
    ID_TIME_FORMAT,
)
from ledgerwake.functions.scalars import clock, content_id, measure
from ledgerwake.schemas import EVENT_SCHEMA, TRANSACTION_COLUMNS

BAD_JSON = "malformed_json"
NO_EVENT_TIME = "event_time_missing"
BAD_EVENT_TIME = "event_time_invalid"

_UNPARSED = "_unparsed"
_DECODING_SCHEMA = T.StructType(
    [*EVENT_SCHEMA.fields, T.StructField(_UNPARSED, T.StringType())]
)


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed transactions plus `payload` and `decode_error` (null when good).

    A measure of NaN stays NaN: detection tells it from a null one.

    Bad records stay in the frame with a reason; `good` and `quarantine` pick the
    two sides.  Works on frames from a topic (binary value) and on text files.
    """
    payload = F.col(value).cast("string")
    event = F.from_json(
        payload,
        _DECODING_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _UNPARSED},
    )
    # A generator is never merged into a later filter, so each message is parsed once
    # however many conditions are put on its fields.
    named = messages.select(payload.alias("payload"), F.inline(F.array(event)))
    named = named.withColumnsRenamed(EVENT_TO_COLUMN)
    moment = parse_time(F.col("event_time"))
    empty = F.coalesce(F.trim("payload"), F.lit("")) == ""
    error = (
        F.when(empty | F.col(_UNPARSED).isNotNull(), BAD_JSON)
        .when(F.col("event_time").isNull(), NO_EVENT_TIME)
        .when(moment.isNull(), BAD_EVENT_TIME)
    )
    typed = {"event_time": moment}
    return named.select(
        *[typed.get(name, F.col(name)).alias(name) for name in TRANSACTION_COLUMNS],
        error.alias("decode_error"),
        "payload",
    )


def decode_lenient(messages: DataFrame, value: str = "value") -> DataFrame:
    """The same columns as `decode`, but a field of the wrong type is null and its record stays good.

    A number in quotes is taken as a number, as a table load by column takes it.  A message
    that is no JSON object is malformed, and so are NaN and Infinity, which JSON does not have.
    """
    payload = F.col(value).cast("string")
    record = F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>")
    parsed = messages.select(payload.alias("payload")).select("payload", F.explode(F.array(record)).alias("record"))
    fields = [
        F.try_variant_get(F.col("record")[f.name], "$", f.dataType.simpleString()).alias(EVENT_TO_COLUMN[f.name])
        for f in EVENT_SCHEMA
    ]
    named = parsed.select("payload", F.col("record").isNull().alias(_UNPARSED), *fields)
    moment = parse_time(F.col("event_time"))
    error = (
        F.when(F.col(_UNPARSED), BAD_JSON)
        .when(F.col("event_time").isNull(), NO_EVENT_TIME)
        .when(moment.isNull(), BAD_EVENT_TIME)
    )
    typed = {"event_time": moment}
    return named.select(
        *[typed.get(name, F.col(name)).alias(name) for name in TRANSACTION_COLUMNS],
        error.alias("decode_error"),
        "payload",
    )


def good(decoded: DataFrame, need_time: bool = True) -> DataFrame:
    """Decoded transactions; without `need_time` also those that carry no event time."""
    accepted = F.col("decode_error").isNull()
    if not need_time:
        accepted = accepted | (F.col("decode_error") == NO_EVENT_TIME)
    return decoded.filter(accepted).select(*TRANSACTION_COLUMNS)


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("decode_error").isNotNull()).select("decode_error", "payload")


def parse_time(text: Column) -> Column:
    """ISO-8601 text to timestamp; anything that is not a full date becomes null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def encode(transactions: DataFrame) -> Column:
    """The event JSON of a transaction row; every field is present, nulls included."""
    fields = []
    for field, column in EVENT_TO_COLUMN.items():
        if column == "event_time":
            part = F.date_format(F.col(column), EVENT_TIME_FORMAT)
        elif column in ("customer_account_balance", "transaction_amount_inr"):
            part = measure(transactions, column)
        else:
            part = F.col(column)
        fields.append(part.alias(field))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def to_messages(transactions: DataFrame, key: str | None = None) -> DataFrame:
    """Frame ready for a topic: `value`, and `key` when a key column is named."""
    message = [encode(transactions).alias("value")]
    if key:
        message.insert(0, F.col(key).cast("string").alias("key"))
    return transactions.select(*message)


def message_bytes(value: Column) -> Column:
    return F.octet_length(value)


def events_from_csv(rows: DataFrame, run_ts=None, row_key: list[str] | None = None) -> DataFrame:
    """CSV rows as transactions stamped with the run time and a fresh id.

    The id is `<run time>-<unique part>`.  Without `row_key` the unique part is
    random; with it, it is a digest of those columns, so a replay gives equal ids.
    """
    now = clock(run_ts)
    unique = content_id(*[F.col(f"`{c}`") for c in row_key]) if row_key else F.uuid()
    named = {
        EVENT_TO_COLUMN[event]: F.col(f"`{column}`") for column, event in CSV_TO_EVENT.items()
    }
    named["transaction_id"] = F.concat_ws("-", F.date_format(now, ID_TIME_FORMAT), unique)
    named["event_time"] = F.date_trunc("second", now)
    return rows.select(*[named[name].alias(name) for name in TRANSACTION_COLUMNS])
