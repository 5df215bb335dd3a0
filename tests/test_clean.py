from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.operators import clean, quantiles, summary
from ledgerwake.plans import jobs
from ledgerwake.sources import files as file_source
from ledgerwake.sinks import files as file_sink

SCHEMA = "key string, n bigint, x double, word string, empty double"
ROWS = [
    ("a", 1, 1.0, "b", None),
    ("b", 4, math.nan, "b", None),
    ("c", 2, 4.0, "a", None),
    ("d", 10, 2.0, "a", None),
    ("e", None, 10.0, None, None),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_key(df):
    return {r.key: r for r in df.collect()}


def test_report(rows):
    found = {r.column_name: r.missing for r in clean.null_report(rows).collect()}
    assert found == {"key": 0, "n": 1, "x": 1, "word": 1, "empty": 5}
    assert clean.with_gaps(clean.null_report(rows)).count() == 4


def test_strategies(rows):
    assert clean.clean(rows, "report") is rows
    assert clean.clean(rows, "drop").count() == 0
    assert clean.clean(rows.drop("empty"), "drop").count() == 3
    mean = by_key(clean.clean(rows, "fill_mean"))
    assert (mean["e"].n, mean["b"].x, mean["e"].word, mean["a"].empty) == (4.25, 4.25, None, None)
    median = by_key(clean.clean(rows, "fill_median"))
    assert (median["e"].n, median["b"].x, median["a"].empty) == (3.0, 3.0, None)
    full = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    assert clean.fill_median(full).schema["n"] == clean.fill_mean(full).schema["n"]
    assert clean.fill_median(full).schema["n"].dataType.typeName() == "long"
    mode = by_key(clean.clean(rows, "fill_mode"))
    assert (mode["e"].n, mode["b"].x, mode["e"].word, mode["a"].empty) == (1, 1.0, "a", None)
    custom = by_key(clean.fill_custom(rows, {"word": "Unknown", "x": 0, "absent": 1}))
    assert (custom["e"].word, custom["b"].x) == ("Unknown", 0.0)
    with pytest.raises(ValueError):
        clean.clean(rows, "guess")


def test_quantiles_against_numpy(spark, monkeypatch):
    """Few bins force several passes."""
    monkeypatch.setattr(quantiles, "BINS", 3)
    generator = random.Random(7)
    cells = [
        (
            float(generator.randint(-50, 50)),
            generator.lognormvariate(0, 4) if generator.random() < 0.9 else None,
            generator.choice([0.1, 0.2, math.nan]),
            generator.choice([-math.inf, 1.0, 2.5, math.inf]),
            generator.choice([-1.7e308, 1.7e308, 3.0]),
        )
        for _ in range(500)
    ]
    columns = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(cells, ", ".join(f"{c} double" for c in columns)).repartition(5)
    wanted = [0.0, 0.05, 0.25, 0.5, 0.731, 1.0]
    found = quantiles.exact_quantiles(df, columns, wanted)
    for position, column in enumerate(columns):
        known = [r[position] for r in cells if r[position] is not None]
        known = np.sort([v for v in known if not math.isnan(v)])
        for p, value in zip(wanted, found[column]):
            place = p * (len(known) - 1)
            low, high = known[math.floor(place)], known[math.ceil(place)]
            assert low <= value <= high, (column, p)
            if low == high:
                assert value == low
    assert found["a"][3] == pytest.approx(np.median([r[0] for r in cells]))


@pytest.mark.parametrize("sign", [1, -1])
def test_values_of_wide_magnitude_need_few_passes(spark, monkeypatch, sign):
    values = [sign * 10.0 ** (n / 40 * 6 - 300) for n in range(4000)] + [0.0, -5e-324, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    passes, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "SKETCH", 10)
    monkeypatch.setattr(quantiles, "_narrow", lambda *args: passes.append(1) or narrow(*args))
    found = quantiles.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9])["x"]
    assert found == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]).tolist())
    assert len(passes) <= 6


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_median_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5])["x"][0] == pytest.approx(np.median(values))


def test_summary(rows):
    row = summary.column_summary(rows, ["x"]).first()
    assert (row.n, row.minimum, row.q50, row.maximum) == (4, 1.0, 3.0, 10.0)
    assert row.stddev == pytest.approx(np.std([1, 4, 2, 10], ddof=1))
    quick = {r.summary: r.x for r in summary.quick_summary(rows.na.drop(subset=["x"]), "x").collect()}
    assert quick["count"] == "4"
    stages = {"read": F.lit(True), "large": F.col("x").between(3, 100), "none": F.lit(False)}
    counts = {r.stage: r.n_rows for r in summary.row_counts(rows, **stages).collect()}
    assert counts == {"read": 5, "large": 2, "none": 0}


def test_signs(spark):
    df = spark.createDataFrame(
        [(str(i), text) for i, text in enumerate(["5", "-7.5", "abc", None] * 300)],
        "key string, `TransactionAmount (INR)` string",
    )
    signed = clean.sign_amounts(df, ["key"])
    moved = clean.sign_amounts(df.repartition(7), ["key"])
    assert signed.exceptAll(moved).isEmpty()
    values = [r[1] for r in signed.collect()]
    known = [v for v in values if v is not None]
    assert len(known) == 600 and {abs(v) for v in known} == {5.0, 7.5}
    assert 0.5 < sum(v < 0 for v in known) / 600 < 0.7
    assert all(r[1] > 0 for r in clean.sign_amounts(df, ["key"], withdrawal_share=0.0).na.drop().collect())
    with pytest.raises(ValueError, match="missing columns"):
        clean.sign_amounts(df.select("key"), ["key"])


def test_csv_reads_as_pandas_does(spark, folder, tmp_path):
    text = 'a,b,c,d\n1,x,NA,"say ""hi"", you"\n2,,1.5,null\n,None,nan,z\n'
    (tmp_path / "in.csv").write_text(text)
    expected = pd.read_csv(tmp_path / "in.csv")
    read = file_source.read_csv(spark, str(tmp_path / "in.csv"))
    assert [f.dataType.typeName() for f in read.schema] == ["long", "string", "double", "string"]
    assert read.toPandas().isna().to_numpy().tolist() == expected.isna().to_numpy().tolist()
    assert read.first().d == 'say "hi", you'
    file_sink.write_csv(read, f"{folder}/out")
    again = file_source.read_csv(spark, f"{folder}/out", read.schema)
    assert read.exceptAll(again).isEmpty() and again.exceptAll(read).isEmpty()


def test_clean_job(spark, folder, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,x\n,y\n4,\n")
    schema = file_source.read_csv(spark, str(tmp_path / "in.csv")).schema
    before, after = jobs.clean_csv(
        spark, str(tmp_path / "in.csv"), f"{folder}/out", f"{folder}/rejected", schema=schema
    )
    assert {r.column_name: r.missing for r in before.collect()} == {"a": 1, "b": 1}
    assert {r.column_name: r.missing for r in after.collect()} == {"a": 0, "b": 1}


def test_csv_by_name_with_rejects(spark, folder, tmp_path):
    text = (
        "TransactionID,amount,CustomerID,note\n"
        't1,10.5,c1,"two\nlines"\nt2,ten,c2,x\nt3,7,c3\nt4,nan,c4,y\n'
    )
    (tmp_path / "in.csv").write_text(text)
    schema = T.StructType(
        [T.StructField("CustomerID", T.StringType()), T.StructField("amount", T.DoubleType())]
    )
    good, rejected = file_source.split_csv(
        spark, str(tmp_path / "in.csv"), schema, multi_line=True
    )
    rows = {tuple(r) for r in good.collect()}
    assert good.columns == ["CustomerID", "amount", "TransactionID", "note"]
    assert rows == {("c1", 10.5, "t1", "two\nlines"), ("c4", None, "t4", "y")}
    assert {r.TransactionID: r.reject_reasons for r in rejected.collect()} == {
        "t2": ["amount_unfit"], "t3": ["ragged"]
    }
    with pytest.raises(ValueError, match="do not fit"):
        file_source.read_csv(spark, str(tmp_path / "in.csv"), schema, multi_line=True)


CELLS = [
    "1", " 2 ", "+3", "-4", "9" * 30, "12.5", ".5", "5.", "1e3", "1d", "2F", "0x1p3", "inf", "-Infinity",
    "+inf", "nAn", "1-1", "01/01/92", "x", "", "e5", "1e", "--1", "0x", "1 2", ".", "\x011", "i", "N",
]


def test_inferred_kinds_are_those_of_the_casts(spark):
    """Whatever is not tried as a number must be none."""
    cells = spark.createDataFrame([(c,) for c in CELLS], "cell string")
    tried = cells.filter(F.col("cell").try_cast("double").isNotNull()).collect()
    formed = cells.filter(F.col("cell").rlike(file_source._NUMBER)).collect()
    assert {r.cell for r in tried} <= {r.cell for r in formed}
    for cell in CELLS:
        one = cells.filter(F.col("cell") == cell).limit(1)
        is_number = any(r.cell == cell for r in tried)
        assert (file_source.infer_types(one)["cell"].dataType != T.StringType()) == is_number


def test_reading_csv_passes_over_the_files_once_to_judge_them(spark, folder):
    """One job with types to find or given, not one for the types and several for the rejects."""
    spark.range(1000).select("id", F.lit("a").alias("t")).repartition(20).write.option("header", True).csv(folder)
    context = spark.sparkContext
    for schema in (None, T.StructType([T.StructField("id", T.LongType())])):
        group = f"{folder}-{schema is None}"
        context.setJobGroup(group, "read")
        try:
            good = file_source.read_csv(spark, folder, schema)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        assert good.count() == 1000
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
        tasks = [info.numCompletedTasks for info in map(status.getStageInfo, stages) if info]
        assert len([n for n in tasks if n > 1]) == 1
    spark.createDataFrame([("1,2",), ("3,4,5",)], "line string").coalesce(1).write.text(f"{folder}-ragged")
    with pytest.raises(ValueError, match="do not fit: ragged"):
        file_source.read_csv(spark, f"{folder}-ragged", None)
