"""CSV and JSON-lines reads, and literal rows."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.fixed_values import MISSING_TOKENS
from ledgerwake.operators.validate import require_columns


# Holds the whole line where a row has more or fewer cells than the header.
_RAGGED = "_ragged_line"


def split_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    header: bool = True,
    multi_line: bool = False,
    stage: str | None = None,
    ragged: Observation | None = None,
    unfit: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV dataset, and the rows that do not fit with `reject_reasons`.

    The usual spellings of a missing cell are read as null.  The columns of `schema` are
    found by their names in the header, wherever they stand; further columns follow as
    text.  Files of one dataset must have the same header.  Without a header the schema
    names the columns in order; without a schema one more pass finds out which columns hold
    only numbers.

    A row does not fit if it has more or fewer cells than the header (`ragged`), or a cell
    that is not of its column's type (`<column>_unfit`).  Line breaks inside quotes need
    `multi_line`, with which a file is read by one task; without it each line of such a row
    is judged as a row.

    Both sides parse the files again each time they are read.  With `stage` the judged rows are
    written to that folder once, and both sides read them from there.  The pass that finds the
    types out notes in `ragged` how many rows are; no other row can fail then.  The first pass
    over the rows that fit notes in `unfit` how many do not, so without a stage the other side
    need be read only where there are some.
    """
    # Cells stay text at first: the reader knows just one spelling of null.  No value of
    # its own may stand for null or the empty string here.
    reader = (
        spark.read.option("header", header)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
    )
    names = _header(spark, reader, path) if header else list(schema.names)
    text = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _RAGGED)])
    raw = (
        reader.option("enforceSchema", False)
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _RAGGED)
        .schema(text)
        .csv(path)
    )
    # As in decoding: what a generator makes is made once, however often it is asked for later.
    known = F.struct(*[_known(c).alias(c) for c in names], _RAGGED)
    cells = raw.select(F.inline(F.array(known)))
    if schema is None:
        seen = cells.observe(ragged, F.count(_RAGGED).alias("n")) if ragged else cells
        schema = infer_types(seen.filter(F.col(_RAGGED).isNull()).drop(_RAGGED))
    else:
        require_columns(cells, *schema.names)
    further = [n for n in names if n not in schema.names]
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    reasons = [F.when(F.col(_RAGGED).isNotNull(), "ragged")] + [
        F.when(F.col(f"`{n}`").isNotNull() & value.isNull(), f"{n}_unfit")
        for n, value in cast.items()
    ]
    judged = cells.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))
    if stage:
        judged.write.parquet(stage)
        judged = spark.read.schema(judged.schema).parquet(stage)
    fails = F.size("reject_reasons") > 0
    seen = judged.observe(unfit, F.count(F.when(fails, 1)).alias("n")) if unfit else judged
    good = seen.filter(~fails).select(
        *[value.alias(n) for n, value in cast.items()], *[F.col(f"`{n}`") for n in further]
    )
    return good, judged.filter(fails)


def _header(spark: SparkSession, reader, path: str | list[str]) -> list[str]:
    """Column names of the files' header; says plainly what is wrong with it."""
    names = reader.csv(path).columns
    if not names:
        raise ValueError(f"{path} is empty, it has no header")
    first = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).first()
    given = [cell for cell in first if cell is not None]
    repeated = sorted({n for n in given if given.count(n) > 1})
    if repeated:
        raise ValueError(f"{path} names columns more than once: {', '.join(repeated)}")
    return names


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """The rows of a CSV dataset in which every row fits; fails where one does not.

    `split_csv` gives both sides instead.
    """
    ragged = Observation() if schema is None else None
    good, rejected = split_csv(spark, path, schema, header, multi_line, ragged=ragged)
    if ragged and not ragged.get["n"]:
        return good
    # In one job: mostly there is no such row, and looking for one meets all files.
    placed = rejected.select(F.monotonically_increasing_id().alias("place"), "reject_reasons")
    first = placed.agg(F.min(F.struct("place", "reject_reasons")).alias("first")).first()["first"]
    if first:
        raise ValueError(f"{path} has rows that do not fit: {', '.join(first['reject_reasons'])}")
    return good


def _known(name: str) -> Column:
    cell = F.col(f"`{name}`")
    return F.when(~cell.isin(*MISSING_TOKENS), cell)


def infer_types(cells: DataFrame) -> T.StructType:
    """Whole number, number or text per column, from one aggregate over all rows.

    A cast that fails costs many times one that holds, so only cells in the form of a number are cast.
    """
    kinds = (T.StringType(), T.DoubleType(), T.LongType())
    tests = []
    for name in cells.columns:
        cell = F.col(f"`{name}`")
        whole = cell.rlike(_WHOLE) & cell.try_cast("bigint").isNotNull()
        rank = F.when(~cell.rlike(_NUMBER), 0).when(whole, 2).when(cell.try_cast("double").isNotNull(), 1).otherwise(0)
        tests.append(F.min(F.when(cell.isNotNull(), rank)))
    found = cells.agg(F.array(*tests).alias("found")).first()["found"]
    # A column without values is one of numbers.
    return T.StructType(
        [T.StructField(n, kinds[1 if k is None else k]) for n, k in zip(cells.columns, found)]
    )


_WHOLE = r"^\s*[+-]?\d+\s*$"
# All that a cast to a double may take: decimal and hexadecimal numbers, infinity and NaN.
_NUMBER = (
    r"^[\x00- ]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?|0[xX].*|[iInN].*)[\x00- ]*$"
)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files in the shape of a topic: one `value` per line."""
    return spark.read.text(path)


def stream_messages(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def add_slice(messages: DataFrame, path: str, files: int = 1) -> None:
    """More files of a topic folder, so one more micro-batch where a trigger takes as many.

    Files are read in the order of their times, which count in milliseconds.
    """
    dealt(messages.select(F.col("value").cast("string")), files).write.mode("append").text(path)
    time.sleep(0.05)


def dealt(rows: DataFrame, files: int) -> DataFrame:
    """Rows for so many files of about one size, each written by a task of its own."""
    return rows.coalesce(1) if files == 1 else rows.repartition(files)


def stream_csv_paths(spark: SparkSession, path: str, max_files_per_trigger: int) -> DataFrame:
    """New files of a folder as a stream of their paths, a bounded number for each micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"))


def literal_rows(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
