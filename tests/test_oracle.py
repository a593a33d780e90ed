"""Every registered query against its DuckDB oracle text (sf0.001: quick)."""
import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from basketry.plans.catalog import ENTRIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def multiset(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


KEYS = {e.key for e in ENTRIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in KEYS}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLES[key])
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(s_rows) == len(d_rows)
    assert multiset(sdf.columns, s_rows) == multiset(rel.columns, d_rows)


def test_every_query_has_an_oracle():
    assert KEYS == set(ORACLES) and KEYS <= set(entry.queries())
