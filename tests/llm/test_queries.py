"""Every pN_ query runs at the smallest scale and, where it has SQL, equals it."""

import os

import duckdb
import pytest

from quillstone.llm.queries import QUERIES
from quillstone.llm.sql import SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        key = lambda f: sorted(tuple(map(str, r)) for r in f[columns].astype(object).itertuples(index=False, name=None))
        assert key(got) == key(want)
