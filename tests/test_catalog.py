"""Every registered query beside its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert canonical(got).equals(canonical(want))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["weekday_type", "time_period", "cpu_state"] and df.count() == 32
