"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["level", "l1", "l2", "l3", "n"] and df.count() > 0


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert ok, note
