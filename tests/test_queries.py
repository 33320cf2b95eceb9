"""Every registered query of the engine against its SQL on the smallest tables; those without SQL must run and repeat."""

import math
import os

import duckdb
import pytest

from foliograph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.columns, want.fetchall())
    else:
        again = QUERIES[name](spark, FOLDER)
        assert got and got == rows_of(again.columns, again.collect())


def test_flagship(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["url_host_counts"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<url:string>" in plan and "html" not in plan.split("Physical Plan")[-1]
