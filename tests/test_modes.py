from __future__ import annotations

import datetime
import math
import random
from collections import Counter
from decimal import Decimal

import pytest

from ledgerwake.operators import clean, modes

KINDS = (
    "hot string, unique string, flat long, few int, price decimal(10,2), x double, day date,"
    " at timestamp, raw binary, none string"
)


def made(n: int = 3000, seed: int = 5) -> list[tuple]:
    pick = random.Random(seed)
    day = datetime.date(2024, 1, 1)
    return [
        (
            "often" if pick.random() < 0.34 else f"w{pick.randrange(10**9)}",
            f"id-{i}",
            i // 2,
            pick.choice([1, 2, 2, None]),
            Decimal(pick.randrange(400)) / 100,
            pick.choice([0.0, -0.0, math.nan, pick.random()]),
            day + datetime.timedelta(pick.randrange(60)),
            datetime.datetime(2024, 5, 1, pick.randrange(24)),
            bytes([pick.randrange(5)]),
            None,
        )
        for i in range(n)
    ]


def brute(rows: list[tuple]) -> list:
    found = []
    for column in zip(*rows):
        seen = Counter(v for v in column if v is not None and v == v)
        found.append(min(seen, key=lambda v: (-seen[v], v)) if seen else None)
    return found


@pytest.mark.parametrize("tracked, candidates", [(6000, 8), (64, 3), (200, 1)])
def test_modes_against_brute_force(spark, monkeypatch, tracked, candidates):
    """Small sketches leave more columns to the hashes; the result stays."""
    monkeypatch.setattr(modes, "TRACKED", tracked)
    monkeypatch.setattr(modes, "CANDIDATES", candidates)
    monkeypatch.setattr(modes, "FEW", tracked)
    rows = made()
    df = spark.createDataFrame(rows, KINDS).repartition(6)
    assert [bytes(v) if isinstance(v, bytearray) else v for v in modes.exact_modes(df)] == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_a_sketch_that_proves_a_mode_is_right(spark, monkeypatch, seed):
    monkeypatch.setattr(modes, "TRACKED", 40)
    pick = random.Random(seed)
    rows = [
        tuple(int(pick.paretovariate(shape)) for shape in (0.4, 0.8, 1.5)) for _ in range(4000)
    ]
    df = spark.createDataFrame(rows, "cell_0 long, cell_1 long, cell_2 long").repartition(5)
    proven = modes.count(df, *modes.candidates(df))
    expected = dict(zip(df.columns, brute(rows)))
    assert proven and all(expected[c] == v for c, v in proven.items())


def test_values_of_hot_and_unique_columns_are_not_shuffled(spark, monkeypatch):
    df = spark.createDataFrame(made(), KINDS).select("hot", "unique")
    monkeypatch.setattr(modes, "FEW", 100)
    counted, top_counts = [], modes.top_counts
    monkeypatch.setattr(modes, "top_counts", lambda cells: counted.append(cells) or top_counts(cells))
    monkeypatch.setattr(modes, "most_frequent", lambda *_: pytest.fail("values were counted"))
    assert modes.exact_modes(df) == ["often", "id-0"]
    (cells,) = counted
    assert dict(cells.dtypes) == {"cell_0": "string", "cell_1": "bigint"}
    assert cells.select("cell_0").distinct().count() <= modes.CANDIDATES + 1


def test_hashes_that_collide_do_not_decide(spark, monkeypatch):
    """With one hash for all values, the count of the hash says nothing about a value."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(modes.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    df = spark.createDataFrame([(v,) for v in "aabbbccd"], "cell_0 string")
    assert modes.count(df, {}) == {"cell_0": "b"}


def test_empty_tables_and_odd_names(spark):
    kinds = "`a b` string, `cell_0` long, `x.y` double"
    empty = spark.createDataFrame([], kinds)
    assert modes.exact_modes(empty) == [None] * 3
    assert clean.column_modes(empty).first().asDict() == {"a b": None, "cell_0": None, "x.y": None}
    assert clean.fill_mode(empty).count() == 0
    rows = spark.createDataFrame([("u", 1, None), ("u", None, 2.0), (None, 1, 2.0)], kinds)
    assert [tuple(r) for r in clean.fill_mode(rows).collect()] == [("u", 1, 2.0)] * 3
    assert clean.column_modes(rows).schema == rows.schema


def test_the_rows_are_made_once(spark):
    made_rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made_rows.add(batch.num_rows)
            yield batch

    table = spark.range(500).selectExpr("id % 7 AS a", "concat('t', id) AS b", "id / 3 AS c")
    assert modes.exact_modes(table.mapInArrow(seen, table.schema)) == [0, "t0", 0.0]
    assert made_rows.value == 500
