"""Every registered query of the library proper against its SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from docloom import queries


def as_rows(df, columns):
    cell = lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[columns].values.tolist())


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for t in ("documents", "pages", "nation", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, tiny, oracle, name):
    got = queries.QUERIES[name](spark, tiny).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        want = oracle.execute(queries.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert as_rows(got, columns) == as_rows(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
