"""Every registered query on the smallest data set, against its SQL twin where it has one."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, rows, _, message = compare(spark, con, name, SF)
    assert ok, message
    assert rows > 0 or name == "filter_county"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
