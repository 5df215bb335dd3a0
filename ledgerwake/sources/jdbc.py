"""Database table reads, split into ranges of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def connection(url: str, user: str, password: str, driver: str | None = None) -> dict[str, str]:
    options = {"url": url, "user": user, "password": password}
    if driver:
        options["driver"] = driver
    return options


def scan_options(
    connect: dict[str, str],
    table: str,
    split_column: str | None = None,
    lower=None,
    upper=None,
    splits: int = 1,
    fetch_rows: int = 10000,
) -> dict[str, str]:
    """Options of a scan.  With a split column `splits` tasks read ranges side by side.

    The bounds only place the splits: the first and last range are open, so rows
    outside the bounds are read too.
    """
    options = {**connect, "dbtable": table, "fetchsize": str(fetch_rows)}
    if split_column is None:
        if splits > 1:
            raise ValueError("more than one split needs a split column")
        return options
    if lower is None or upper is None:
        raise ValueError("a split column needs both bounds")
    return {
        **options,
        "partitionColumn": split_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(splits),
    }


def read(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**scan_options(**options)).load()
