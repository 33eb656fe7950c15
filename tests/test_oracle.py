"""Every registered query against its SQL on the smallest test set."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from gridsurvey.checks import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, small, name):
    problem, rows, _ = compare(spark, con, small, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    assert rows > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"season", "pba3_block", "checklist_count"} <= set(df.columns)
