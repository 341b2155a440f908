"""Dates and times."""

from __future__ import annotations

from brindle.functions.math import _form
from brindle.functions.registry import Function

FUNCTIONS: dict[str, list[Function]] = {
    "GETDATE": [Function((), "datetime", _form("localtimestamp()"))],
    "GETUTCDATE": [Function((), "datetime", _form("CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)"))],
    "DAY": [Function(("datetime",), "int", _form("day({0})"))],
    "MONTH": [Function(("datetime",), "int", _form("month({0})"))],
    "YEAR": [Function(("datetime",), "int", _form("year({0})"))],
}
