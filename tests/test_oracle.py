"""Every oracle-checked query against its DuckDB SQL on the sf0.01 tables (the driver's gate; at
sf0.001 several selector queries would have no repeated rows to work on)."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
from tools.oracle_check import TABLES, rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(ocols, cur.fetchall())
