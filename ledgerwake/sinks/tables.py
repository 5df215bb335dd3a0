"""Keyed tables as plain Parquet folders, partitioned by a function of the key.

Equal keys fall into one partition, so a write looks at the partitions of its own rows and at
nothing else.  Insert-ignore only appends.  Beside the table it keeps one bit for each hashed key
it has written; a row whose bit is not set is new, and only partitions of rows whose bit is set
are read at all, and of these only the key.  Upsert replaces the partitions it touches.

Writes follow key rules, so repeating one changes nothing.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.operators import keyed
from ledgerwake.operators.validate import conform, keyed_rows

# Column of the partition that follows from the key, and how many there are by default.
PART, PARTS = "key_part", 16
# Bits that hold hashed keys of one partition; a bitmap of Spark has 32,768 of them.
KEY_BITS = 1 << 20


def hashed_part(keys: Sequence[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


class KeyedTable:
    """`part` says which partition a row is in; it must follow from the key, and may read columns
    that the table does not store.  Without it the key is hashed.  `also` names further partition
    columns, which readers can filter by.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        part: Column | None = None,
        also: Mapping[str, Column] | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.keys = list(keys)
        self.layout = {PART: hashed_part(keys) if part is None else part, **(also or {})}

    def read(self) -> DataFrame:
        """One row per key."""
        return self.partitions().select(*self.schema.names)

    def partitions(self, parts: Sequence | None = None) -> DataFrame:
        """Stored rows with their partition columns; of the named partitions only, if any are named."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self._stored())
        rows = self.spark.read.schema(self._stored()).parquet(self.path)
        return rows if parts is None else rows.filter(F.col(PART).isin(list(parts)))

    def _stored(self) -> T.StructType:
        """The table's columns and the partition columns, typed as they come back from folder names."""
        kinds = [T.StructField(PART, T.StringType())]
        kinds += [T.StructField(name, T.DateType()) for name in self.layout if name != PART]
        return T.StructType([*self.schema.fields, *kinds])

    def placed(self, batch: DataFrame) -> DataFrame:
        """The batch in the table's types, with its partition columns."""
        part = F.coalesce(self.layout[PART].cast("string"), F.lit("none"))
        placed = batch.withColumns({PART: part})
        return conform(placed.withColumns({c: v for c, v in self.layout.items() if c != PART}), self._stored())

    def _parts(self, rows: DataFrame) -> list:
        """The partitions of some rows: at most as many as the table has."""
        return list(self._part_sizes(rows))

    def _part_sizes(self, rows: DataFrame) -> dict:
        return {r[0]: r[1] for r in rows.groupBy(PART).agg(F.count("*")).collect()}

    def _write(self, rows: DataFrame, mode: str, path: str, **options) -> None:
        """Few files to a folder: rows of a folder meet first, and large folders are split again."""
        rows = rows.hint("rebalance", *self.layout)
        rows.write.mode(mode).options(**options).partitionBy(*self.layout).parquet(path)

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


class InsertIgnoreTable(KeyedTable):
    """The first row written for a key stays."""

    def append(self, batch: DataFrame) -> None:
        """Adds all rows; like a primary key, refuses a batch that would repeat a key."""
        rows = self.placed(batch)
        if not keyed.duplicate_keys(rows, self.keys).isEmpty():
            raise ValueError(f"repeated key {self.keys} inside the batch")
        if not self._known(rows).isEmpty():
            raise ValueError(f"key {self.keys} is already in the table")
        self._add(rows)

    def insert(self, batch: DataFrame, order_by: Sequence[str] = ()) -> int:
        """Adds the rows with new keys and tells how many they were.

        The batch is read more than once, so its first rows are written down beside the table
        until they are in it.  Only columns that a check needs are read from there.
        """
        rows = keyed_rows(self.placed(batch), self.keys)
        rows, known, old = keyed.first_per_key(rows, self.keys, order_by), None, 0
        rows.write.mode("overwrite").parquet(self.batch_path)
        try:
            rows = self.spark.read.schema(self._stored()).parquet(self.batch_path)
            offered = self._part_sizes(rows)
            if offered and self._exists(self.bits_path):
                known = self._known(rows, list(offered)).persist()
                old = known.count()
            new = sum(offered.values()) - old
            if new:
                self._add(rows.join(known, [PART, *self.keys], "left_anti") if old else rows)
            return new
        finally:
            if known is not None:
                known.unpersist()
            self._remove(self.batch_path)

    @property
    def batch_path(self) -> str:
        return f"{self.path}-batch"

    @property
    def bits_path(self) -> str:
        return f"{self.path}-bits"

    def _hashed(self, rows: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit("bits"), *self.keys), F.lit(KEY_BITS)) + 1
        return rows.select(
            PART,
            *self.keys,
            F.bitmap_bucket_number(place).alias("slot"),
            F.bitmap_bit_position(place).alias("bit"),
        )

    def _known(self, rows: DataFrame, parts: Sequence | None = None) -> DataFrame:
        """Partition and key of the rows that are in the table; `parts` names the rows' partitions."""
        suspects = self.suspects(rows, parts)
        # Rows with a bit that is not set are new; mostly there is nothing to read.
        parts = self._parts(suspects)
        if not parts:
            return suspects.limit(0)
        return self.partitions(parts).select(PART, *self.keys).join(suspects, [PART, *self.keys], "left_semi")

    def suspects(self, rows: DataFrame, parts: Sequence | None = None) -> DataFrame:
        """Partition and key of placed rows whose bit is set: all known ones, and few others."""
        hashed = self._hashed(rows)
        if not self._exists(self.bits_path):
            return hashed.select(PART, *self.keys).limit(0)
        kind = T.StructType([T.StructField("slot", T.LongType()), T.StructField("bits", T.BinaryType()),
                             T.StructField(PART, T.StringType())])
        bits = self.spark.read.schema(kind).parquet(self.bits_path)
        bits = bits.filter(F.col(PART).isin(list(parts or self._parts(rows))))
        bits = bits.join(hashed.select(PART, "slot").distinct(), [PART, "slot"], "left_semi")
        bits = bits.groupBy(PART, "slot").agg(F.bitmap_or_agg("bits").alias("bits"))
        octet = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
        shifted = F.call_function("shiftright", octet.cast("int"), (F.col("bit") % 8).cast("int"))
        is_set = shifted.bitwiseAND(F.lit(1)) == 1
        return hashed.join(bits, [PART, "slot"]).filter(is_set).select(PART, *self.keys)

    def _add(self, rows: DataFrame) -> None:
        """Bits first: a bit without its row costs a look, a row without its bit could come twice."""
        bits = self._hashed(rows).groupBy(PART, "slot")
        bits = bits.agg(F.bitmap_construct_agg("bit").alias("bits")).hint("rebalance", PART)
        bits.write.mode("append").partitionBy(PART).parquet(self.bits_path)
        self._write(rows, "append", self.path)


class UpsertTable(KeyedTable):
    """The last row written for a key replaces all earlier ones."""

    def upsert(self, batch: DataFrame, order_by: Sequence[str] = ()) -> None:
        """Rewrites the partitions of the batch's keys, others stay as they are."""
        self._finish()
        ordered = keyed_rows(batch, self.keys)
        rows = self.placed(keyed.latest_per_key(ordered, self.keys, order_by))
        parts = self._parts(rows)
        if parts:
            merged = keyed.upsert(self.partitions(parts), rows, self.keys, [])
            self._write(merged, "overwrite", self._pending("parts"))
            self._finish()

    def overwrite(self, df: DataFrame) -> None:
        """The table becomes exactly these rows; readers see the old ones until the end."""
        self._finish()
        self._write(self.placed(df), "overwrite", self._pending("whole"))
        self._finish()

    def read(self) -> DataFrame:
        self._finish()
        return super().read()

    def _pending(self, kind: str) -> str:
        return f"{self.path}-pending-{kind}"

    def _finish(self) -> None:
        """Puts a complete pending write into the table.

        Replacing folders is not one step, so what replaces them is written down before; a run that
        ended in between is finished by the next one.
        """
        for kind, mode in (("parts", "dynamic"), ("whole", "static")):
            pending = self._pending(kind)
            if self._exists(f"{pending}/_SUCCESS"):
                rows = self.spark.read.schema(self._stored()).parquet(pending)
                self._write(rows, "overwrite", self.path, partitionOverwriteMode=mode)
                self._remove(pending)
