from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ledgerwake.plans.catalogue import catalogue
from ledgerwake.plans.oracle import oracle
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert catalogue().keys() == oracle().keys()
    assert entry.queries().keys() >= catalogue().keys()
    assert entry.queries().keys() >= entry.oracle_sql().keys() >= oracle().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 150


@pytest.mark.parametrize("name", catalogue())
def test_query_equals_sql(spark, duck, name):
    actual = catalogue()[name](spark, SF_DIR).toPandas()
    expected = duck.execute(oracle()[name]).fetchdf()
    assert differences(actual, expected) == ""
