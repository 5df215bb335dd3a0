"""File writes and bounded previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Options of large text files: nearly as small as at gzip's usual level, for half the CPU seconds.
SMALL = {"compression": "gzip", "zlib.compress.level": "THREE"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """CSV with a header; quotes inside a cell are doubled, missing cells are empty."""
    df.write.mode(mode).option("header", True).option("escape", '"').options(**options).csv(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def preview(df: DataFrame, rows: int = 200) -> None:
    df.show(rows, truncate=False)


def console(stream: DataFrame, name: str):
    return stream.writeStream.queryName(name).format("console").option("truncate", False)
