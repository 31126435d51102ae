"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from pulsefeat.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Their expected rows name rules that need more distinct values than the smallest tables have.
LARGER_ONLY = {"near_constant", "missing_features"}


def connect():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float) or type(value).__name__ in ("Decimal", "float64"):
        return f"{float(value) + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in LARGER_ONLY])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    result = connect().execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, result.fetchall())
