"""Random conditions and expressions over columns with nulls: one Spark job against one of DuckDB."""

import random

import duckdb
import pytest

from brindle.catalog import Catalog
from brindle.query import Query

ROWS = [(i, i % 4 if i % 3 else None, float(i % 5) - 2 if i % 4 else None, "ab cAB"[: i % 7] if i % 5 else None, [True, False, None][i % 3]) for i in range(60)]


def number(rng, depth):
    """The same expression in the dialect and in DuckDB's SQL."""
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([("a", "a"), ("k", "k"), ("3", "3"), ("(0 - 2)", "(0 - 2)")])
    x, y = number(rng, depth - 1), number(rng, depth - 1)
    p = condition(rng, depth - 1)
    return rng.choice(
        [
            (f"({x[0]} + {y[0]})", f"({x[1]} + {y[1]})"),
            (f"({x[0]} * {y[0]} - 1)", f"({x[1]} * {y[1]} - 1)"),
            (f"({x[0]} / NULLIF({y[0]}, 0))", f"CAST(trunc(CAST({x[1]} AS DOUBLE) / nullif({y[1]}, 0)) AS INTEGER)"),
            (f"({x[0]} % NULLIF({y[0]}, 0))", f"({x[1]} % nullif({y[1]}, 0))"),
            (f"(CASE WHEN {p[0]} THEN {x[0]} ELSE {y[0]} END)", f"(CASE WHEN {p[1]} THEN {x[1]} ELSE {y[1]} END)"),
            (f"COALESCE({x[0]}, {y[0]})", f"coalesce({x[1]}, {y[1]})"),
            (f"({x[0]} & {y[0]})", f"({x[1]} & {y[1]})"),
            (f"LEN(s + {x[0]})", f"CAST(length(s || CAST({x[1]} AS VARCHAR)) AS INTEGER)"),
            (f"ABS({x[0]})", f"abs({x[1]})"),
        ]
    )


def condition(rng, depth):
    if depth == 0:
        return rng.choice([("b", "b"), ("a > 1", "a > 1"), ("s LIKE 'A%b'", "s ILIKE 'A%b'"), ("f < 0.5", "f < 0.5"), ("s IS NULL", "s IS NULL"), ("k IN (1, 5, a)", "k IN (1, 5, a)")])
    x, y = number(rng, depth - 1), number(rng, depth - 1)
    p, q = condition(rng, depth - 1), condition(rng, depth - 1)
    op = rng.choice(["=", "<>", "<", ">="])
    return rng.choice(
        [
            (f"({p[0]} AND {q[0]})", f"({p[1]} AND {q[1]})"),
            (f"({p[0]} OR {q[0]})", f"({p[1]} OR {q[1]})"),
            (f"(NOT ({p[0]}))", f"(NOT ({p[1]}))"),
            (f"({x[0]} {op} {y[0]})", f"({x[1]} {op} {y[1]})"),
            (f"({x[0]} BETWEEN {y[0]} AND 3)", f"({x[1]} BETWEEN {y[1]} AND 3)"),
            (f"({x[0]} NOT IN (1, {y[0]}))", f"({x[1]} NOT IN (1, {y[1]}))"),
            (f"({x[0]} IS NOT NULL)", f"({x[1]} IS NOT NULL)"),
            (f"(({p[0]}) ^ ({q[0]}))", f"(({p[1]}) <> ({q[1]}))"),
        ]
    )


@pytest.mark.parametrize("seed", range(4))
def test_conditions(spark, seed):
    rng = random.Random(seed)
    pairs = [condition(rng, 3) for _ in range(25)] + [number(rng, 3) for _ in range(15)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, a INTEGER, f DOUBLE, s VARCHAR, b BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", ROWS)
    catalog = Catalog(spark).with_table("t", spark.createDataFrame(ROWS, "k int, a int, f double, s string, b boolean"))
    mine = Query(catalog, "SELECT k, " + ", ".join(f"{p[0]} AS x{i}" for i, p in enumerate(pairs)) + " FROM t ORDER BY k").dataframe().collect()
    twin = con.execute("SELECT k, " + ", ".join(f"{p[1]} AS x{i}" for i, p in enumerate(pairs)) + " FROM t ORDER BY k").fetchall()
    for i, p in enumerate(pairs):
        assert [r[i + 1] for r in mine] == [r[i + 1] for r in twin], p[0]


@pytest.mark.parametrize("seed", range(3))
def test_filters_and_groups(spark, seed):
    rng = random.Random(100 + seed)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, a INTEGER, f DOUBLE, s VARCHAR, b BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", ROWS)
    catalog = Catalog(spark).with_table("t", spark.createDataFrame(ROWS, "k int, a int, f double, s string, b boolean"))
    p, q = condition(rng, 2), condition(rng, 2)
    mine = Query(catalog, f"SELECT a, COUNT(*) AS n, SUM(f) AS s, MIN(s) AS m FROM t WHERE {p[0]} OR k < 20 GROUP BY a UNION ALL SELECT k, 1, f, s FROM t WHERE {q[0]}").dataframe().collect()
    twin = con.execute(f"SELECT a, count(*), sum(f), min(s) FROM t WHERE {p[1]} OR k < 20 GROUP BY a UNION ALL SELECT k, 1, f, s FROM t WHERE {q[1]}").fetchall()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, twin))
