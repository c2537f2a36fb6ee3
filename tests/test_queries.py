"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
from cohortlab.plans import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()
#: Its parts have SQL of their own; together they would take too long there.
WITHOUT_SQL = {"generate_epochs"}


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    state, note, _, _ = compare(spark, connection, name, queries()[name], SQL.get(name), SF_DIR)
    assert state == ("ROWS" if name in WITHOUT_SQL else "OK"), note
