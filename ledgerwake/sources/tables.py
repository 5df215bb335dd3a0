"""The given parquet tables, and transactions derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.fixed_values import RAW_DECIMAL


LINE_KEYS = ("l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Suppliers whose places may go to every task, some 40 bytes each; the places of more are joined.
SENT_PLACES = 1_000_000


def line_transactions(spark: SparkSession, sf_dir: str, send_places: bool = False) -> DataFrame:
    """Order lines as bank transactions; the line keys tell repeats apart.

    Customers join the orders and nations the suppliers first, so the long table takes
    part in one join on the order key and one on the supplier key.  With `send_places` the second
    one shuffles no lines while suppliers are at most `SENT_PLACES`.
    """
    holders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    places = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    if send_places and table(spark, sf_dir, "supplier").count() <= SENT_PLACES:
        places = F.broadcast(places)
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(holders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    price = F.col("l_extendedprice")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.date_format("o_orderdate", "dd/MM/yy").alias("customer_dob"),
        F.substring("c_mktsegment", 1, 1).alias("customer_gender"),
        F.col("n_name").alias("customer_location"),
        (F.col("c_acctbal") * 20).cast(RAW_DECIMAL).alias("customer_account_balance"),
        F.when(F.col("l_returnflag") == "R", -price)
        .otherwise(price)
        .cast(RAW_DECIMAL)
        .alias("transaction_amount_inr"),
        F.col("l_shipdate").alias("event_time"),
        *LINE_KEYS,
    )


def event_transactions(events: DataFrame) -> DataFrame:
    """The event table as transactions; works on a batch and on a streaming frame."""
    points = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.lit(None).cast("string").alias("customer_dob"),
        F.lit(None).cast("string").alias("customer_gender"),
        F.col("event_type").alias("customer_location"),
        (points * 10).cast(RAW_DECIMAL).alias("customer_account_balance"),
        F.col("value").cast(RAW_DECIMAL).alias("transaction_amount_inr"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files.

    A stream wants a folder or a pattern.  The pattern here has one match, so it serves
    a table that is one file as well as one that is a folder of files.
    """
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def sent_slices(spark: SparkSession, sf_dir: str, again: bool = True) -> list[DataFrame]:
    """Events in the order in which they are sent: by third of the month, with repeats and late rows.

    The third slice sends some rows of the second again.  The last one also holds rows of the
    first days under new ids, long after the watermark has passed them.  Without `again` each
    event is sent once.
    """
    rows = event_transactions(table(spark, sf_dir, "events"))
    day, number = F.dayofmonth("event_time"), F.col("transaction_id").cast("long")
    first, second, third = day <= 8, (day > 8) & (day <= 16), (day > 16) & (day <= 24)
    if not again:
        return [rows.filter(part) for part in (first, second, third, day > 24)]
    late = rows.filter(first & (number % 20 == 3))
    late = late.withColumn("transaction_id", F.concat(F.lit("late-"), "transaction_id"))
    return [
        rows.filter(first),
        rows.filter(second),
        rows.filter(third).unionByName(rows.filter(second & (number % 50 == 7))),
        rows.filter(day > 24).unionByName(late),
    ]


# Rows of a slice that one file may hold, about 100 MB as messages.
SLICE_ROWS = 500_000


def slice_files(spark: SparkSession, sf_dir: str) -> int:
    """Files for each of the four slices, so that no task writes or reads a whole large one."""
    return 1 + table(spark, sf_dir, "events").count() // (4 * SLICE_ROWS)


# Rows of one CSV file, where a folder of them is made.
CSV_ROWS = 2_000_000


def csv_files(spark: SparkSession, sf_dir: str) -> int:
    """Files for each third of the lines, so that no task writes or reads a whole large one."""
    return 1 + table(spark, sf_dir, "lineitem").count() // (3 * CSV_ROWS)


def gappy_transactions(transactions: DataFrame) -> DataFrame:
    """Line transactions as doubles with gaps: nulls and NaN placed by other columns."""
    line_no, gender = F.col("l_linenumber"), F.col("customer_gender")
    return transactions.select(
        "transaction_id",
        F.when(~((line_no == 2) & (gender == "B")), F.col("customer_id")).alias("customer_id"),
        F.when(line_no != 4, F.col("customer_dob")).alias("customer_dob"),
        F.when(line_no != 5, gender).alias("customer_gender"),
        F.when(~((line_no == 6) & (gender == "M")), F.col("customer_location")).alias(
            "customer_location"
        ),
        F.when(line_no == 1, None)
        .when((line_no == 3) & (gender == "A"), F.lit(float("nan")))
        .otherwise(F.col("customer_account_balance").cast("double"))
        .alias("customer_account_balance"),
        F.when((line_no == 7) & (gender == "H"), None)
        .when((line_no == 7) & (gender == "F"), F.lit(float("nan")))
        .otherwise(F.col("transaction_amount_inr").cast("double"))
        .alias("transaction_amount_inr"),
        "event_time",
        *LINE_KEYS,
    )


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock values, the form the given tables use."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
