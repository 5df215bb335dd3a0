"""What several operators of this folder need: staged tables, Arrow helpers, held-out rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.session import brief_shuffles, setting, work_folder  # noqa: F401

# White space of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Later steps read the files, so nothing above is computed again and a lost executor
    costs only its own tasks.
    """
    spark = df.sparkSession
    folder = work_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def held_out(doc_id: Column, parts: int) -> Column:
    """True where crc32 of the id as text leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [value or "" for value in batch.column(name).to_pylist()]


def same_as_before(*columns: list) -> np.ndarray:
    """True where a row of parallel lists equals the row above it; the first is False."""
    rows = list(zip(*columns))
    return np.array([False, *(a == b for a, b in zip(rows, rows[1:]))], dtype=bool)[: len(rows)]


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker process keeps between tasks: the last thing asked for, and nothing older."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Lets go of what earlier stages kept in this worker; for tasks that need room of their own."""
    _kept.clear()


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
