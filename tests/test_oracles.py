"""Every query with SQL gives DuckDB's rows; every query without gives some."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, list):
        return tuple(map(cell, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def told(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def same(spark, duck, name, sf=SF):
    df = entry.queries()[name](spark, sf)
    got = told([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = told(result.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}
    for c in result.description:
        if str(c[1]) in kinds:
            assert dict(df.dtypes)[c[0]] == kinds[str(c[1])], c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    if name in entry.oracle_sql():
        same(spark, duck, name)
    else:
        assert entry.queries()[name](spark, SF).count() >= 0
