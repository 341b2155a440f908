"""What Spark made of a query, step by step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from brindle.query import Query


@dataclass(frozen=True)
class Step:
    """name: parsed, analyzed, optimized or physical; text: the plan as a tree."""

    name: str
    text: str


def steps(query: Query | DataFrame) -> list[Step]:
    df = query.dataframe() if isinstance(query, Query) else query
    held = df._jdf.queryExecution()
    return [Step("parsed", held.logical().toString()), Step("analyzed", held.analyzed().toString()), Step("optimized", held.optimizedPlan().toString()), Step("physical", held.executedPlan().toString())]


def explain(query: Query | DataFrame) -> str:
    """The physical plan with its details."""
    df = query.dataframe() if isinstance(query, Query) else query
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
