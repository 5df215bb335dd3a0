"""Database table writes.

Spark's writer appends or overwrites.  Insert-ignore and upsert load a staging table in
parallel and then merge it with one statement inside the database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerwake.fixed_values import JDBC_BATCH_ROWS
from ledgerwake.operators import keyed
from ledgerwake.sources import jdbc as source


def write_options(
    connect: dict[str, str], table: str, batch_rows: int = JDBC_BATCH_ROWS, writers: int = 8
) -> dict[str, str]:
    """`writers` bounds the connections open at a time."""
    return {
        **connect,
        "dbtable": table,
        "batchsize": str(batch_rows),
        "numPartitions": str(writers),
    }


def append(df: DataFrame, **options) -> None:
    df.write.format("jdbc").options(**write_options(**options)).mode("append").save()


def overwrite(df: DataFrame, **options) -> None:
    """Replaces all rows; truncating keeps the table's keys and indexes."""
    settings = {**write_options(**options), "truncate": "true"}
    df.write.format("jdbc").options(**settings).mode("overwrite").save()


def insert_ignore_statement(
    table: str, staging: str, columns: Sequence[str], keys: Sequence[str]
) -> str:
    listed = ", ".join(columns)
    return (
        f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging}"
        f" ON CONFLICT ({', '.join(keys)}) DO NOTHING"
    )


def upsert_statement(
    table: str, staging: str, columns: Sequence[str], keys: Sequence[str]
) -> str:
    """The staging table must hold one row per key: see `keyed.latest_per_key`."""
    listed = ", ".join(columns)
    changes = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns if c not in keys)
    return (
        f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging}"
        f" ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {changes}"
    )


def merge(df: DataFrame, statement: str, staging: str, connect: dict[str, str]) -> int:
    """Loads the staging table and runs the merge statement on the driver's connection.

    Returns the rows that the statement added or changed.
    """
    overwrite(df, connect=connect, table=staging)
    jvm = df.sparkSession._jvm
    if "driver" in connect:
        jvm.java.lang.Class.forName(connect["driver"])
    session = jvm.java.sql.DriverManager.getConnection(
        connect["url"], connect["user"], connect["password"]
    )
    try:
        return session.createStatement().executeUpdate(statement)
    finally:
        session.close()


class DatabaseTable:
    """A database table with the calls of `sinks.tables`, for jobs that write to either.

    The table has a primary key or a unique index on `keys`.  Its staging table belongs to one
    writer; merging the same rows again changes nothing, so a repeated micro-batch is harmless.
    """

    def __init__(
        self, spark: SparkSession, connect: dict[str, str], table: str, schema: T.StructType,
        keys: Sequence[str], staging: str | None = None,
    ):
        self.spark, self.connect, self.table = spark, connect, table
        self.schema, self.keys, self.staging = schema, list(keys), staging or f"{table}_staging"

    def read(self, **split) -> DataFrame:
        """All rows; `split_column`, `lower`, `upper` and `splits` read ranges side by side."""
        rows = source.read(self.spark, connect=self.connect, table=self.table, **split)
        return rows.select(*self.schema.names)

    def insert(self, batch: DataFrame, order_by: Sequence[str] = ()) -> int:
        """Adds the rows with new keys and tells how many they were."""
        rows = keyed.first_per_key(batch.na.drop(subset=self.keys), self.keys, order_by)
        return self._merge(rows, insert_ignore_statement)

    def upsert(self, batch: DataFrame, order_by: Sequence[str] = ()) -> int:
        """Replaces the rows of the batch's keys and adds new ones."""
        rows = keyed.latest_per_key(batch.na.drop(subset=self.keys), self.keys, order_by)
        return self._merge(rows, upsert_statement)

    def append(self, batch: DataFrame) -> None:
        """Adds all rows; the database refuses a repeated key."""
        append(self._fitting(batch), connect=self.connect, table=self.table)

    def overwrite(self, df: DataFrame) -> None:
        overwrite(self._fitting(df), connect=self.connect, table=self.table)

    def _fitting(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[rows[f.name].cast(f.dataType) for f in self.schema])

    def _merge(self, rows: DataFrame, statement) -> int:
        text = statement(self.table, self.staging, self.schema.names, self.keys)
        return merge(self._fitting(rows), text, self.staging, self.connect)
