"""Every registered query against its oracle, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, spark_rows
from leadloom.plans import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(load()))
def test_query(spark, name):
    query = load()[name]
    df = query(spark, FOLDER)
    if query.oracle:
        assert difference(df, query.oracle, FOLDER) is None
    else:
        assert spark_rows(df)[0]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["step", "variation", "sent", "replied", "reply_rate"] and df.count() > 0
