"""Every registered query with SQL gives the same rows as that SQL."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(con, QUERIES[name](spark, sf), SQL[name]) is None


def test_entry(spark):
    r = entry.entry(spark).first()
    assert r.tp + r.fn > 0 and 0 <= r.f1 <= 1
