"""Every query against its SQL, over the smallest tables; queries without SQL run and keep their schema."""

import __spark_entry__ as entry
import oracle
import pytest

BASE = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(BASE)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, con, name):
    assert oracle.compare(spark, QUERIES[name], SQL[name], BASE, con) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    df = QUERIES[name](spark, BASE)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
