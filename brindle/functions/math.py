"""Mathematics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from brindle.functions.registry import Bound, Function

Builder = Callable[[Sequence[Bound]], str]


def _form(form: str) -> Builder:
    """form: Spark SQL with {0}, {1} for the arguments."""
    return lambda args: form.format(*(a.sql for a in args))


def _double(form: str, n: int = 1) -> list[Function]:
    return [Function(("double",) * n, "double", _form(form))]


_SIGNED = ("decimal", "double", "float", "long", "int", "short", "sbyte")
# Logarithms of 0 are -Infinity and of negative numbers NaN, where Spark has null.
_LOG = "(CASE WHEN {0} > 0 THEN %s WHEN {0} = 0 THEN double('-Infinity') WHEN {0} IS NOT NULL THEN double('NaN') END)"

FUNCTIONS: dict[str, list[Function]] = {
    "ABS": [Function((t,), t, _form("abs({0})")) for t in _SIGNED],
    "CEILING": [Function(("double",), "double", _form("CAST(ceil({0}) AS DOUBLE)")), Function(("decimal",), "decimal", _form("CAST(ceil({0}) AS DECIMAL(38,18))"))],
    "FLOOR": _double("CAST(floor({0}) AS DOUBLE)"),
    "ROUND": [
        Function(("double",), "double", _form("round({0})")),
        Function(("decimal",), "decimal", _form("CAST(round({0}) AS DECIMAL(38,18))")),
        Function(("double", "int"), "double", _form("round({0}, {1})")),
        Function(("decimal", "int"), "decimal", _form("CAST(round({0}, {1}) AS DECIMAL(38,18))")),
    ],
    "SIGN": [Function((t,), "int", _form("CAST(sign({0}) AS INT)")) for t in _SIGNED],
    "LOG": [*_double(_LOG % "ln({0})"), Function(("double", "double"), "double", _form(_LOG % "log({1}, {0})"))],
    "LOG10": _double(_LOG % "log10({0})"),
    "ATAN2": _double("atan2({0}, {1})", 2),
    "POW": _double("power({0}, {1})", 2),
} | {name: _double(f"{name.lower()}({{0}})") for name in ("ACOS", "ASIN", "ATAN", "COS", "COSH", "SIN", "SINH", "TAN", "TANH", "EXP", "SQRT")}
