"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checking import differences, rows_of, second_engine

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine(sf_dir):
    return second_engine(sf_dir)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, engine):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in SQL:
        cursor = engine.execute(SQL[name])
        want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
        assert not differences(got, want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["model", "n", "accuracy"]
    assert df.count() == 5
