"""Compares a query with its SQL run by DuckDB on the same tables.

`python -m tests.compare <sf_dir> [names]` prints one line per query.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def differences(actual: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty when both hold the same rows under the same columns."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} vs {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} vs {len(expected)}"
    columns = sorted(actual.columns)
    kinds = [(c, _kind(actual[c]), _kind(expected[c])) for c in columns]
    other = [k for k in kinds if k[1] != k[2]]
    if other:
        return f"types {other}"
    left, right = (_rows(frame[columns]) for frame in (actual, expected))
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def _kind(column: pd.Series) -> str:
    known = column.dropna()
    if known.empty:
        return "empty"
    value = known.iloc[0]
    if isinstance(value, pd.Timestamp):
        return "time"
    if pd.api.types.is_number(value):
        # A whole-number column with nulls becomes float in pandas.
        return "number"
    return type(value).__name__


def _rows(frame: pd.DataFrame) -> list[tuple]:
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple("∅" if pd.isna(v) else _text(v) for v in row))
    return sorted(out)


def _text(value) -> str:
    if isinstance(value, float):
        return repr(value + 0.0)
    if pd.api.types.is_integer(value):
        return repr(float(value))
    return str(value)


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            actual = query(spark, sf_dir).toPandas()
            took = time.time() - began
            wrong = differences(actual, connection.execute(sql[name]).fetchdf())
        except Exception as error:  # every query gets its line
            took, wrong = time.time() - began, f"{type(error).__name__} {str(error)[:700]}"
        failed += bool(wrong)
        print(f"{name:28s} {took:6.2f}s {wrong or 'same'}", flush=True)
    print(f"{failed} differ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
