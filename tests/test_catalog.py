"""Every query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

import __spark_entry__
from locusframe.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for f in os.listdir(D):
        end = "/*.parquet" if os.path.isdir(f"{D}/{f}") else ""
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}{end}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, D).toPandas(), sql.sql(catalog.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
