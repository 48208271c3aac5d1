"""Every registered query equals its SQL on the smallest tables."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

WITHOUT_SQL = set()
TRAINING_DATA = re.compile(r"op\d+_|pipeline$")  # tested in a folder of their own


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_contract(spark):
    assert {n for n in set(queries()) - set(oracle_sql()) if not TRAINING_DATA.match(n)} == WITHOUT_SQL
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, con, name):
    df = queries()[name](spark, sf)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
