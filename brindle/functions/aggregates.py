"""The aggregates: each gives Spark SQL and a type from its bound argument."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from brindle.dialect.types import INTEGERS, NUMERIC, OPAQUE, SMALL, SPARK, Type
from brindle.functions.conversion import as_text
from brindle.functions.registry import Bound


@dataclass(frozen=True)
class Aggregate:
    """type_of: None if the argument's type is not supported; build(argument, strict)."""

    type_of: Callable[[Type], Type | None]
    build: Callable[[Bound, bool], str]


def _numeric(result: Callable[[Type], Type]) -> Callable[[Type], Type | None]:
    return lambda t: result(t) if t in NUMERIC or t == "null" else None


def _sum_type(t: Type) -> Type:
    """Spark sums integers as long, which cannot wrap around as soon as an int would."""
    return "long" if t in SMALL or t in INTEGERS or t == "null" else t


def _avg(x: Bound, strict: bool) -> str:
    if strict and (x.type in SMALL or x.type in INTEGERS):
        return f"(sum({x.sql}) div count({x.sql}))"
    return f"CAST(avg({x.sql}) AS DECIMAL(38,18))" if x.type == "decimal" else f"avg({x.sql})"


def _concat(x: Bound, _: bool) -> str:
    text = f"trim({as_text(x)})"
    return f"coalesce(listagg(DISTINCT {text}, ', ') WITHIN GROUP (ORDER BY {text}), '')"


def _comparable(t: Type) -> Type | None:
    return None if t in OPAQUE or not isinstance(t, str) else t


AGGREGATES: dict[str, Aggregate] = {
    "COUNT": Aggregate(lambda t: "long", lambda x, _: f"count({x.sql})"),
    "SUM": Aggregate(_numeric(_sum_type), lambda x, _: f"sum(CAST({x.sql} AS {SPARK[_sum_type(x.type)]}))" if x.type in SMALL else f"sum({x.sql})"),
    "AVG": Aggregate(_numeric(lambda t: t if t in ("float", "decimal") else "double"), _avg),
    "MIN": Aggregate(_comparable, lambda x, _: f"min({x.sql})"),
    "MAX": Aggregate(_comparable, lambda x, _: f"max({x.sql})"),
    "STDEV": Aggregate(_numeric(lambda t: "double"), lambda x, strict: f"stddev_samp({_zeroed(x, strict)})"),
    "VAR": Aggregate(_numeric(lambda t: "double"), lambda x, strict: f"var_samp({_zeroed(x, strict)})"),
    "CONCAT": Aggregate(lambda t: "string" if isinstance(t, str) and t != "binary" else None, _concat),
}


def _zeroed(x: Bound, strict: bool) -> str:
    """In strict mode a null counts as zero here."""
    return f"coalesce(CAST({x.sql} AS DOUBLE), 0D)" if strict else f"CAST({x.sql} AS DOUBLE)"
