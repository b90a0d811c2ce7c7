"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        err, _ = compare(df, con, sql)
        assert err is None, err


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_key_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
