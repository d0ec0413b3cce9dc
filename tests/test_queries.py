"""Every query that has SQL for an independent engine, against it."""

import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (date, datetime)) else v


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    df = driver.queries()[name](spark, SF)
    cursor = oracle.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    shown = lambda rows: sorted(([plain(r[k]) for k in sorted(columns)] for r in rows), key=repr)
    assert shown(r.asDict() for r in df.collect()) == shown(expected)


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
