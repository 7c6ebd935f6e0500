"""Every core query runs at the smallest scale and, where it has SQL, equals it."""

import math
import os

import duckdb
import pytest

from quillstone.plans import catalogue


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name in catalogue.SQL:
        frame = duck.sql(catalogue.SQL[name]).arrow()
        want = [tuple(r.values()) for r in frame.read_all().to_pylist()] if hasattr(frame, "read_all") else [tuple(r.values()) for r in frame.to_pylist()]
        names = (frame.schema if hasattr(frame, "schema") else frame).names
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, want)


def test_entry_works_without_the_subpackage():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql())
