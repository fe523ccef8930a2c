"""Every query against its comparison SQL on the smallest tables."""

import oracle_check
import pytest

import __spark_entry__ as entry
from logloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    same, got, want, a, b = oracle_check.compare(spark, con, SF, name)
    assert a == b
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
