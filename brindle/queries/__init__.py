"""The verified queries: each in the dialect, with its twin in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.queries import api, pack

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**{name: pack.runner(text) for name, text, _ in pack.QUERIES}, **api.QUERIES}
ORACLE: dict[str, str] = {**{name: sql for name, _, sql in pack.QUERIES if sql}, **api.ORACLE}
