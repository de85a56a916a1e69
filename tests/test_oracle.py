"""Every registered query with an SQL equivalent gives the same rows as that SQL."""

import duckdb
import pytest
from conftest import SF_DIR

from __spark_entry__ import oracle_sql, queries
from check_oracle import TABLES, compare

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    state, n, _took, note = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert state == "OK", f"{state} {n} {note}"


def test_entry_returns_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
