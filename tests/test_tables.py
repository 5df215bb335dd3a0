from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.sinks import tables
from ledgerwake.sinks.tables import PART, InsertIgnoreTable, UpsertTable

SCHEMA = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("v", T.LongType()),
        T.StructField("day", T.StringType()),
    ]
)


def rows(spark, *cells, day="2024-01-01"):
    return spark.createDataFrame([(k, v, day) for k, v in cells], SCHEMA)


def content(table):
    return sorted((r.k, r.v) for r in table.read().collect())


def by_day(spark, folder, **options):
    """Keys that begin with their day."""
    return InsertIgnoreTable(spark, folder, SCHEMA, ["k"], F.substring("k", 1, 2), **options)


@pytest.mark.parametrize("with_day", [False, True])
def test_insert_ignore(spark, folder, with_day):
    also = {"event_day": F.to_date("day")} if with_day else None
    table = InsertIgnoreTable(spark, folder, SCHEMA, ["k"], also=also)
    assert content(table) == []
    first = rows(spark, ("a", 2), ("a", 1), ("b", 5))
    with pytest.raises(Exception, match="lacks its key"):
        table.insert(rows(spark, (None, 9)), ["v"])
    table.insert(first, ["v"])
    assert content(table) == [("a", 1), ("b", 5)]
    table.insert(first, ["v"])
    assert content(table) == [("a", 1), ("b", 5)]
    # A key stays known where its row would go to another folder of `also`.
    table.insert(rows(spark, ("b", 0), ("c", 3), day="2024-02-02"), ["v"])
    assert content(table) == [("a", 1), ("b", 5), ("c", 3)]
    table.insert(rows(spark, ("c", 4), ("d", 4)), ["v"])
    assert content(table) == [("a", 1), ("b", 5), ("c", 3), ("d", 4)]
    assert not glob.glob(f"{folder}/version=*")


def test_append_refuses_known_keys(spark, folder):
    table = InsertIgnoreTable(spark, folder, SCHEMA, ["k"])
    table.append(rows(spark, ("a", 1)))
    with pytest.raises(ValueError, match="inside the batch"):
        table.append(rows(spark, ("b", 1), ("b", 2)))
    with pytest.raises(ValueError, match="already in the table"):
        table.append(rows(spark, ("a", 2), ("c", 2)))
    assert content(table) == [("a", 1)]


def spoil(folder, part):
    """Makes a partition unreadable, so that whoever opens it fails."""
    found = glob.glob(f"{folder}/{PART}={part}/**/*.parquet", recursive=True)
    for name in found:
        with open(name, "wb") as file:
            file.write(b"spoilt")
    for name in glob.glob(f"{folder}/{PART}={part}/**/.*.crc", recursive=True):
        with open(name, "wb") as file:
            file.write(b"")
    assert found


def test_a_batch_reads_only_partitions_its_keys_fall_into(spark, folder):
    table = by_day(spark, folder)
    table.insert(rows(spark, ("d1-a", 1), ("d2-a", 1), ("d3-a", 1)))
    scan = table.partitions(["d1"])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({PART}" in scan and "= d1)" in scan
    spoil(folder, "d2")
    table.insert(rows(spark, ("d1-a", 9), ("d1-b", 2), ("d3-a", 9)))
    assert sorted(r.k for r in table.partitions(["d1", "d3"]).collect()) == ["d1-a", "d1-b", "d3-a"]
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET"):
        table.insert(rows(spark, ("d2-a", 9)))


def test_new_keys_read_no_partition_at_all(spark, folder):
    table = by_day(spark, folder)
    table.insert(rows(spark, ("d1-a", 1), ("d1-b", 1)))
    spoil(folder, "d1")
    table.insert(rows(spark, ("d1-c", 1), ("d1-d", 1)))
    assert table.suspects(table.placed(rows(spark, ("d1-c", 0), ("d1-x", 0)))).collect() == [("d1", "d1-c")]


def test_keys_that_share_a_bit_are_told_apart(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "KEY_BITS", 2)
    table = InsertIgnoreTable(spark, folder, SCHEMA, ["k"])
    table.insert(rows(spark, *[(f"k{n}", n) for n in range(40)]))
    table.insert(rows(spark, *[(f"k{n}", -n) for n in range(20, 90)]))
    assert content(table) == sorted((f"k{n}", n if n < 40 else -n) for n in range(90))


def test_a_write_that_broke_off_after_its_bits_is_repeated(spark, folder, monkeypatch):
    table = InsertIgnoreTable(spark, folder, SCHEMA, ["k"])
    table.insert(rows(spark, ("a", 1)))
    with monkeypatch.context() as m:
        m.setattr(InsertIgnoreTable, "_write", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.insert(rows(spark, ("b", 2)))
    assert content(table) == [("a", 1)]
    table.insert(rows(spark, ("b", 3)))
    assert content(table) == [("a", 1), ("b", 3)]


def test_null_part(spark, folder):
    table = by_day(spark, folder)
    table.layout[PART] = F.lit(None)
    for _ in range(2):
        table.insert(rows(spark, ("a", 1)))
    assert content(table) == [("a", 1)]


def test_upsert(spark, folder):
    table = UpsertTable(spark, folder, SCHEMA, ["k"])
    table.upsert(rows(spark, ("a", 1), ("a", 2), ("b", 5)), ["v"])
    assert content(table) == [("a", 2), ("b", 5)]
    change = rows(spark, ("a", 0), ("c", 1))
    table.upsert(change, ["v"])
    table.upsert(change, ["v"])
    assert content(table) == [("a", 0), ("b", 5), ("c", 1)]
    table.upsert(rows(spark).limit(0))
    table.overwrite(rows(spark, ("z", 1)))
    assert content(table) == [("z", 1)]
    table.upsert(rows(spark, ("z", 2)))
    assert content(table) == [("z", 2)]
    table.overwrite(rows(spark).limit(0))
    assert content(table) == []


def test_upsert_leaves_other_partitions_alone(spark, folder):
    table = UpsertTable(spark, folder, SCHEMA, ["k"], F.substring("k", 1, 2))
    table.upsert(rows(spark, ("d1-a", 1), ("d2-a", 1)))
    spoil(folder, "d2")
    table.upsert(rows(spark, ("d1-a", 2), ("d1-b", 1)))
    assert sorted(r.v for r in table.partitions(["d1"]).collect()) == [1, 2]


def test_an_upsert_that_broke_off_is_finished(spark, folder, monkeypatch):
    table = UpsertTable(spark, folder, SCHEMA, ["k"])
    table.upsert(rows(spark, ("a", 1), ("b", 1)))
    with monkeypatch.context() as m:
        write = UpsertTable._write

        def broken(self, df, mode, path, **options):
            if path == self.path:  # folders gone, replacement not yet there
                self._remove(path)
                raise ZeroDivisionError
            write(self, df, mode, path, **options)

        m.setattr(UpsertTable, "_write", broken)
        with pytest.raises(ZeroDivisionError):
            table.upsert(rows(spark, ("a", 2), ("b", 2)))
    assert content(table) == [("a", 2), ("b", 2)]


def test_work_folder_is_below_the_shared_folder(spark, folder):
    assert folder.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/")


def test_an_insert_takes_few_tasks_for_few_rows(spark, folder):
    """Not one per shuffle partition for each look at the batch, and nothing stays beside the table."""
    context, table = spark.sparkContext, InsertIgnoreTable(spark, folder, SCHEMA, ["k"])
    table.insert(rows(spark, ("a", 1), ("b", 5)), ["v"])
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    context.setJobGroup(folder, "insert")
    try:
        assert table.insert(rows(spark, ("b", 0), ("c", 3)), ["v"]) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup(folder)]
    stages = {s for job in jobs for s in job.stageIds}
    sizes = [info.numCompletedTasks for info in map(status.getStageInfo, stages) if info]
    assert sizes and max(sizes) < 64
    assert not glob.glob(f"{folder}-batch*")
    assert content(table) == [("a", 1), ("b", 5), ("c", 3)]
