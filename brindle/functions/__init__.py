"""The scalar functions and aggregates of the dialect, as builders of Spark SQL.

REGISTRY has every scalar function's overloads by upper-case name. A builder
gets bound arguments (sql, type, value) and gives Spark SQL; all but the few in
python.py stay on the JVM. Every function gives null if an argument is null.
"""

from __future__ import annotations

from brindle.functions import conversion, dates, math, text
from brindle.functions.registry import Function, resolve

REGISTRY: dict[str, list[Function]] = {**conversion.FUNCTIONS, **math.FUNCTIONS, **text.FUNCTIONS, **dates.FUNCTIONS}

__all__ = ["REGISTRY", "Function", "resolve"]
