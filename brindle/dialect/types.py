"""The dialect's types by name, what converts to what, and their Spark counterparts.

Spark has no unsigned types; they are widened: byte in a smallint, ushort in an
int, uint in a bigint, ulong in a decimal(20, 0). A struct's type is the tuple
("struct", ((field, type), ...)).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

Type = Any

# The dialect's type names in CAST.
CAST_NAMES = {
    "BOOL": "bool", "BOOLEAN": "bool", "BYTE": "byte", "SBYTE": "sbyte", "CHAR": "char", "SHORT": "short", "INT16": "short", "USHORT": "ushort", "UINT16": "ushort",
    "INT": "int", "INT32": "int", "UINT": "uint", "UINT32": "uint", "LONG": "long", "INT64": "long", "ULONG": "ulong", "UINT64": "ulong", "FLOAT": "float",
    "SINGLE": "float", "DOUBLE": "double", "DECIMAL": "decimal", "STRING": "string", "OBJECT": "object",
}
# Implicit numeric conversions, narrow to wide.
_WIDER = {
    "sbyte": "short int long float double decimal", "byte": "short ushort int uint long ulong float double decimal", "short": "int long float double decimal",
    "ushort": "int uint long ulong float double decimal", "char": "ushort int uint long ulong float double decimal", "int": "long float double decimal",
    "uint": "long ulong float double decimal", "long": "float double decimal", "ulong": "float double decimal", "float": "double", "double": "", "decimal": "",
}
IMPLICIT = {k: frozenset(v.split()) for k, v in _WIDER.items()}
INTEGERS = ("int", "uint", "long", "ulong")
SMALL = ("sbyte", "byte", "short", "ushort", "char")
NUMERIC = frozenset(IMPLICIT)
SPARK = {
    "bool": "boolean", "sbyte": "tinyint", "byte": "smallint", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)",
    "float": "float", "double": "double", "decimal": "decimal(38,18)", "string": "string", "char": "string", "datetime": "timestamp_ntz", "binary": "binary", "timespan": "interval day to second",
}
#: Types that cannot be grouped, sorted or compared for distinctness.
OPAQUE = ("binary", "object")


def of_spark(kind: T.DataType) -> Type:
    simple = {
        T.BooleanType: "bool", T.ByteType: "sbyte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "decimal",
        T.StringType: "string", T.DateType: "datetime", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.BinaryType: "binary", T.DayTimeIntervalType: "timespan", T.NullType: "null",
    }
    if isinstance(kind, T.StructType):
        return ("struct", tuple((f.name, of_spark(f.dataType)) for f in kind.fields))
    return next((v for k, v in simple.items() if isinstance(kind, k)), "object")


def shown(kind: Type) -> str:
    return kind if isinstance(kind, str) else "struct"


def converts(source: Type, target: Type) -> bool:
    """Implicitly."""
    return source == target or source == "null" or target == "object" or target in IMPLICIT.get(source, ())


def common(kinds: list[Type]) -> Type | None:
    """The one of some types that all others convert to."""
    real = [k for k in dict.fromkeys(kinds) if k != "null"]
    if not real:
        return "null"
    return next((k for k in real if all(converts(o, k) for o in real)), None)


def promoted(*kinds: Type) -> Type | None:
    """The type that arithmetic on some types has: small integers count as int; a decimal and a float meet as double."""
    wide = ["int" if k in SMALL else k for k in kinds if k != "null"]
    if not wide:
        return "int"
    if any(not isinstance(k, str) or k not in NUMERIC for k in wide):
        return None
    if "decimal" in wide and ("float" in wide or "double" in wide):
        return "double"
    if "ulong" in wide and ("int" in wide or "long" in wide):
        return "decimal"
    for target in ("int", "uint", "long", "ulong", "float", "double", "decimal"):
        if target in wide + ["long"] * ("uint" in wide and "int" in wide) and all(converts(k, target) for k in wide):
            return target
    return None
