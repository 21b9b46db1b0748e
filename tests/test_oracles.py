"""Every query with a SQL counterpart gives the same rows, types and values in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted((tuple(map(normal, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names, kinds = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert ordered(df.select(*[f"`{c}`" for c in columns]).collect()) == ordered(want)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
