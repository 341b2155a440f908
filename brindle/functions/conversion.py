"""TO_BOOLEAN, TO_INT32 and their kin. Numbers round half to even on the way to integers; strings are parsed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from brindle.dialect.types import INTEGERS, SMALL, SPARK
from brindle.functions.cultures import INVARIANT, Culture, culture_of, read, written
from brindle.functions.registry import Bound, Function

# Ranges of the types that Spark has only wider ones for.
RANGES = {"byte": (0, 255), "ushort": (0, 65_535), "uint": (0, 2**32 - 1), "ulong": (0, 2**64 - 1)}


def as_text(x: Bound, culture: Culture = INVARIANT) -> str:
    """A value as the dialect writes it: True and False, no needless fraction; dates and marks of a culture."""
    if x.type in ("string", "char"):
        return x.sql
    if x.type == "bool":
        return f"(CASE WHEN {x.sql} THEN 'True' WHEN NOT {x.sql} THEN 'False' END)"
    if x.type == "datetime":
        return f"date_format({x.sql}, '{culture.date} {culture.time}')"
    if x.type in ("double", "float"):
        return written(f"regexp_replace(CAST({x.sql} AS STRING), '\\\\.0$', '')", culture)
    if x.type == "decimal":
        return written(f"regexp_replace(CAST({x.sql} AS STRING), '\\\\.?0+$', '')", culture)
    return f"CAST({x.sql} AS STRING)"


def to_integer(x: Bound, target: str) -> str:
    value = f"bround({x.sql})" if x.type in ("double", "float", "decimal") else f"CAST({x.sql} AS INT)" if x.type == "bool" else x.sql
    cast = f"CAST({value} AS {SPARK[target]})"
    if target not in RANGES:
        return cast
    low, high = RANGES[target]
    return f"(CASE WHEN {cast} IS NULL THEN NULL WHEN {cast} BETWEEN {low} AND {high} THEN {cast} ELSE raise_error('value out of range') END)"


def _convert(target: str) -> Callable[[Sequence[Bound]], str]:
    def build(args: Sequence[Bound]) -> str:
        x = args[0]
        culture = culture_of(args[1]) if len(args) > 1 else INVARIANT
        if target == "string":
            return as_text(x, culture)
        if target == "bool":
            return f"CAST({x.sql} AS BOOLEAN)" if x.type in ("string", "bool", "null") else f"({x.sql} <> 0)"
        if target == "char":
            if x.type in INTEGERS + SMALL and x.type != "char":
                return f"chr({x.sql})"
            return f"(CASE WHEN length({x.sql}) = 1 THEN {x.sql} WHEN {x.sql} IS NOT NULL THEN raise_error('a single character is needed') END)"
        if target == "datetime":
            if x.type != "string" or len(args) < 2:
                return f"CAST({x.sql} AS TIMESTAMP_NTZ)"
            tried = ", ".join(f"CAST(try_to_timestamp({x.sql}, '{form}') AS TIMESTAMP_NTZ)" for form in (f"{culture.date} {culture.time}", culture.date))
            return f"coalesce({tried}, CAST({x.sql} AS TIMESTAMP_NTZ))"
        if len(args) > 1 and x.type == "string":
            x = replace(x, sql=read(x.sql, culture, target in ("double", "float", "decimal")))
        if target in ("double", "float", "decimal"):
            return f"CAST({x.sql} AS {SPARK[target]})"
        return to_integer(x, target)

    return build


_TARGETS = {
    "BOOLEAN": "bool", "BYTE": "byte", "SBYTE": "sbyte", "CHAR": "char", "DATETIME": "datetime", "DECIMAL": "decimal", "DOUBLE": "double", "SINGLE": "float",
    "INT16": "short", "INT32": "int", "INT64": "long", "UINT16": "ushort", "UINT32": "uint", "UINT64": "ulong", "STRING": "string",
}
FUNCTIONS = {f"TO_{name}": [Function(("any",), kind, _convert(kind)), Function(("any", "string"), kind, _convert(kind))] for name, kind in _TARGETS.items()}
