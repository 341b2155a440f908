"""The few functions that Spark's expressions cannot give, as vectorized Python functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b"}


def unescape(text: str) -> str:
    """A regular expression's escapes undone."""

    def one(m: re.Match[str]) -> str:
        code = m.group(1)
        if code[0] in "xu" and len(code) > 1:
            return chr(int(code[1:], 16))
        return _PLAIN.get(code, code)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", one, text, flags=re.DOTALL)


def format_number(value: float, mask: str) -> str:
    """A number by a standard mask (N2, F0, P1, E3, D5, X, C, G) or by one of digits (#,##0.00)."""
    standard = re.fullmatch(r"([A-Za-z])(\d*)", mask)
    if standard:
        kind, places = standard.group(1).upper(), int(standard.group(2) or (0 if standard.group(1).upper() in "DX" else 6 if standard.group(1).upper() == "E" else 2))
        if kind == "G" or not mask:
            return f"{value:.15g}"
        if kind == "D":
            return f"{int(value):0{places + (value < 0)}d}"
        if kind == "X":
            return f"{int(value) & (2**64 - 1 if value < 0 else ~0):0{places}{'X' if mask[0] == 'X' else 'x'}}"
        if kind == "E":
            digits, _, power = f"{value:.{places}e}".partition("e")
            return f"{digits}{mask[0]}{power[0]}{int(power[1:]):03d}"
        if kind == "P":
            return f"{value * 100:,.{places}f} %"
        if kind == "C":
            return f"¤{value:,.{places}f}" if value >= 0 else f"(¤{-value:,.{places}f})"
        return f"{value:,.{places}f}" if kind == "N" else f"{value:.{places}f}"
    found = re.search(r"[#0,]+(?:\.[#0]+)?", mask)
    if not found:
        return mask if mask else f"{value:.15g}"
    whole, _, part = found.group().partition(".")
    least, most = part.count("0"), len(part)
    shown = f"{abs(value):.{most}f}"
    left, _, right = shown.partition(".")
    right = right[:least] + right[least:].rstrip("0")
    left = left.lstrip("0").rjust(whole.count("0"), "0")
    if "," in whole and left:
        left = f"{int(left):,}".rjust(len(left), "0")
    sign = "-" if value < 0 and (left.strip("0") or right.strip("0")) else ""
    return mask[: found.start()] + sign + left + ("." + right if right else "") + mask[found.end() :]


def register(spark: SparkSession, name: str) -> None:
    if name == "brindle_unescape":

        @F.pandas_udf("string")
        def many(text: pd.Series) -> pd.Series:
            return text.map(unescape, na_action="ignore")

    else:

        @F.pandas_udf("string")
        def many(value: pd.Series, mask: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(v) or m is None else format_number(v, m) for v, m in zip(value, mask, strict=True)], dtype=object)

    spark.udf.register(name, many)
