"""Every named query with an oracle gives the oracle's rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import TABLES, fold

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def test_oracles_name_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert fold(df.columns, rows) == fold(columns, cursor.fetchall())
