"""Every query of the pack against DuckDB on the same files."""

import decimal
import math

import duckdb
import pytest

from brindle.queries import ORACLE, QUERIES
from brindle.sources import TABLES


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    held = oracle.execute(ORACLE[name])
    assert df.columns == [c[0] for c in held.description]
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == sorted(repr(tuple(map(plain, r))) for r in held.fetchall())
