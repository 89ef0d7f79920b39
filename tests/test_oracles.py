"""Every registered query against its SQL counterpart at the smallest scale."""

import pytest
from compare import connect, difference

import __spark_entry__ as spark_entry

# The corpus queries, some of which SQL cannot express, have tests beside their operators.
OWN = spark_entry._registered()
QUERIES = {name: query for name, query in spark_entry.queries().items() if name in OWN}
SQL = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(OWN) <= set(SQL) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, folder, con, name):
    assert difference(con, SQL[name], QUERIES[name](spark, folder)) is None


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 83 and "avg_royalty_rate" in df.columns
