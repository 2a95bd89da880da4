"""Every query with SQL, against DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracewell.plans import QUERIES, SQL

SF = os.environ.get("TRACEWELL_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | datetime.datetime):
        return str(v)
    if isinstance(v, decimal.Decimal | float | int):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() >= 0
        return
    found = duck.execute(SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want and got
