"""Properties and methods of values: x.Length, d.AddDays(1)."""

from __future__ import annotations

from brindle.functions.math import _form
from brindle.functions.registry import Function


def _part(name: str) -> Function:
    return Function(("datetime",), "int", _form(f"CAST({name}({{0}}) AS INT)"))


#: By (type, upper-case name); the target is the first argument.
PROPERTIES: dict[tuple[str, str], Function] = {
    ("string", "LENGTH"): Function(("string",), "int", _form("length({0})")),
    ("datetime", "DAYOFWEEK"): Function(("datetime",), "int", _form("(dayofweek({0}) - 1)")),
    ("datetime", "DATE"): Function(("datetime",), "datetime", _form("date_trunc('day', {0})")),
    ("timespan", "DAYS"): Function(("timespan",), "int", _form("CAST(extract(DAY FROM {0}) AS INT)")),
    ("timespan", "HOURS"): Function(("timespan",), "int", _form("CAST(extract(HOUR FROM {0}) AS INT)")),
    ("timespan", "MINUTES"): Function(("timespan",), "int", _form("CAST(extract(MINUTE FROM {0}) AS INT)")),
    ("timespan", "TOTALDAYS"): Function(("timespan",), "double", _form("(CAST(CAST({0} AS INTERVAL SECOND) AS DECIMAL(30,6)) / 86400)")),
} | {("datetime", n.upper()): _part(n) for n in ("Year", "Month", "Day", "Hour", "Minute", "Second", "DayOfYear")}

METHODS: dict[tuple[str, str], list[Function]] = {
    ("datetime", "ADDDAYS"): [Function(("datetime", "double"), "datetime", _form("CAST(({0} + {1} * INTERVAL '1' DAY) AS TIMESTAMP_NTZ)"))],
    ("datetime", "ADDHOURS"): [Function(("datetime", "double"), "datetime", _form("CAST(({0} + {1} * INTERVAL '1' HOUR) AS TIMESTAMP_NTZ)"))],
    ("datetime", "ADDMINUTES"): [Function(("datetime", "double"), "datetime", _form("CAST(({0} + {1} * INTERVAL '1' MINUTE) AS TIMESTAMP_NTZ)"))],
    ("datetime", "ADDSECONDS"): [Function(("datetime", "double"), "datetime", _form("CAST(({0} + {1} * INTERVAL '1' SECOND) AS TIMESTAMP_NTZ)"))],
    ("datetime", "ADDMONTHS"): [Function(("datetime", "int"), "datetime", _form("({0} + make_ym_interval(0, {1}))"))],
    ("datetime", "ADDYEARS"): [Function(("datetime", "int"), "datetime", _form("({0} + make_ym_interval({1}, 0))"))],
    ("string", "TOUPPER"): [Function(("string",), "string", _form("upper({0})"))],
    ("string", "TOLOWER"): [Function(("string",), "string", _form("lower({0})"))],
    ("string", "TRIM"): [Function(("string",), "string", _form("trim({0})"))],
    ("string", "STARTSWITH"): [Function(("string", "string"), "bool", _form("startswith({0}, {1})"))],
    ("string", "ENDSWITH"): [Function(("string", "string"), "bool", _form("endswith({0}, {1})"))],
    ("string", "CONTAINS"): [Function(("string", "string"), "bool", _form("contains({0}, {1})"))],
    ("string", "INDEXOF"): [Function(("string", "string"), "int", _form("(locate({1}, {0}) - 1)"))],
    ("string", "REPLACE"): [Function(("string", "string", "string"), "string", _form("replace({0}, {1}, {2})"))],
    ("string", "SUBSTRING"): [Function(("string", "int"), "string", _form("substring({0}, {1} + 1)")), Function(("string", "int", "int"), "string", _form("substring({0}, {1} + 1, {2})"))],
}
