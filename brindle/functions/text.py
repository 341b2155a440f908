"""Strings and regular expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from brindle.functions import cultures
from brindle.functions.math import _form
from brindle.functions.python import unescape
from brindle.functions.registry import Bound, Function


def _strings(form: str, n: int = 1, result: str = "string") -> list[Function]:
    return [Function(("string",) * n, result, _form(form))]


def _cultured(make: Callable[[str, cultures.Culture], str]) -> list[Function]:
    return [
        Function(("string",), "string", lambda args: make(args[0].sql, cultures.INVARIANT)),
        Function(("string", "string"), "string", lambda args: make(args[0].sql, cultures.culture_of(args[1]))),
    ]


def soundex(x: str) -> str:
    """The code of a word: its first letter and three digits.

    Letters up to the first that is none are coded: v for vowels (and Y), h for
    H and W. A digit equal to the last one counts again only if a vowel stands
    right before it, so a digit with its repeats, each right behind or behind an
    h, is one.
    """
    codes = "'AEIOUYHWBFPVCGJKQSXZDTLMNR', 'vvvvvvhh11112222222233455" + "6'"
    letters = f"regexp_extract(upper({x}), '^.[A-Z]*', 0)"
    marks = f"translate({letters}, {codes})"
    single = f"regexp_replace({marks}, '([1-6])(?:(?:[vh]*h)?\\\\1)+', '$1')"
    digits = f"regexp_replace(substring({single}, 2), '[vh]', '')"
    return f"(CASE WHEN {x} = '' THEN '0000' ELSE concat(upper(substring({x}, 1, 1)), rpad({digits}, 3, '0')) END)"


def _format(args: Sequence[Bound]) -> str:
    from brindle.functions.conversion import as_text

    value, mask = args[0], args[1]
    culture = cultures.culture_of(args[2]) if len(args) > 2 else cultures.INVARIANT
    if value.type == "datetime" and mask.literal:
        # The common letters of date masks mean the same to Spark, but for the era-proof year and AM/PM.
        return f"date_format({value.sql}, {quoted(str(mask.value).replace('tt', 'a'))})"
    if value.type in ("string", "char", "bool"):
        return as_text(value, culture)
    native = _masked(value, str(mask.value)) if mask.literal and mask.value is not None else None
    return cultures.written(native or f"brindle_format(CAST({value.sql} AS DOUBLE), {mask.sql})", culture)


def _masked(value: Bound, mask: str) -> str | None:
    """A number by a mask, as Spark SQL; None where only the Python function knows the mask."""
    x = value.sql
    standard = re.fullmatch(r"([NFPDXE])(\d*)", mask, re.IGNORECASE)
    if standard:
        kind, given = standard.group(1).upper(), standard.group(2)
        places = int(given or {"D": 0, "X": 0, "E": 6}.get(kind, 2))
        if kind == "N":
            return f"format_number({x}, {places})"
        if kind == "F":
            return f"replace(format_number({x}, {places}), ',', '')"
        if kind == "P":
            return f"concat(format_number(CAST({x} AS DOUBLE) * 100, {places}), ' %')"
        if kind == "E":
            # Spark writes two digits of the power, the dialect three.
            return f"regexp_replace(printf('%.{places}{mask[0]}', CAST({x} AS DOUBLE)), '([+-])([0-9][0-9])$', '$10$2')"
        digits = f"CAST(abs(CAST({x} AS BIGINT)) AS STRING)" if kind == "D" else f"hex(CAST({x} AS BIGINT))"
        digits = f"lower({digits})" if mask[0] == "x" else digits
        padded = f"lpad({digits}, greatest(length({digits}), {places}), '0')"
        return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {padded})" if kind == "D" else padded
    # Without any 0 the dialect writes nothing for zero, Java's formats a 0.
    if "0" in mask and re.fullmatch(r"#*0*(,#*0*)?(\.0*#*)?", mask):
        return f"format_number(CAST({x} AS DOUBLE), '{mask}')"
    return None


def _unescape(args: Sequence[Bound]) -> str:
    x = args[0]
    return quoted(unescape(x.value)) if x.literal and x.value is not None else f"brindle_unescape({x.sql})"


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _length_checked(name: str) -> Callable[[Sequence[Bound]], str]:
    return lambda a: f"(CASE WHEN {a[1].sql} < 0 THEN raise_error('a length cannot be negative') ELSE {name}({a[0].sql}, {a[1].sql}) END)"


_SUBSTRING = "(CASE WHEN {1} = 0 THEN '' WHEN {1} < 0 THEN raise_error('start cannot be negative') ELSE substring({0}, {1}%s) END)"
_BLANKS = r"'[\\t\\n\\x0B\\f\\r \\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+'"
_TRIM = "regexp_replace({0}, concat('^', " + _BLANKS + ", '|', " + _BLANKS + ", '$'), '')"
_ESCAPE = r"replace(replace(replace(replace(regexp_replace({0}, '([\\\\*+?|{{\\[()^$.# ])', '\\\\$1'), '\t', '\\t'), '\n', '\\n'), '\r', '\\r'), '\f', '\\f')"

FUNCTIONS: dict[str, list[Function]] = {
    "SOUNDEX": [Function(("string",), "string", lambda a: soundex(a[0].sql))],
    "LEN": _strings("length({0})", result="int"),
    "CHARINDEX": _strings("(CASE WHEN {0} = '' OR {1} = '' THEN 0 ELSE locate({0}, {1}) END)", 2, "int"),
    "SUBSTRING": [Function(("string", "int"), "string", _form(_SUBSTRING % "")), Function(("string", "int", "int"), "string", _form(_SUBSTRING % ", {2}"))],
    "UPPER": _cultured(cultures.upper),
    "LOWER": _cultured(cultures.lower),
    "TRIM": _strings(_TRIM),
    "LTRIM": _strings("ltrim(' \t', {0})"),
    "RTRIM": _strings("rtrim(' \t', {0})"),
    "REPLACE": _strings("(CASE WHEN {1} = '' THEN raise_error('nothing to replace') ELSE replace({0}, {1}, {2}) END)", 3),
    "REGEX_REPLACE": _strings("regexp_replace({0}, {1}, {2})", 3),
    "REGEX_MATCH": _strings("({0} RLIKE {1})", 2, "bool"),
    "REGEX_ESCAPE": _strings(_ESCAPE),
    "REGEX_UNESCAPE": [Function(("string",), "string", _unescape, "brindle_unescape")],
    "FORMAT": [Function(("any", "string"), "string", _format, "brindle_format"), Function(("any", "string", "string"), "string", _format, "brindle_format")],
    "REPLICATE": [Function(("string", "int"), "string", _form("repeat({0}, {1})"))],
    "REVERSE": _strings("reverse({0})"),
    "LEFT": [Function(("string", "int"), "string", _length_checked("left"))],
    "RIGHT": [Function(("string", "int"), "string", _length_checked("right"))],
    "SPACE": [Function(("int",), "string", _form("repeat(' ', greatest({0}, 0))"))],
    "LPAD": [Function(("string", "int"), "string", _form("lpad({0}, greatest({1}, length({0})), ' ')"))],
    "RPAD": [Function(("string", "int"), "string", _form("rpad({0}, greatest({1}, length({0})), ' ')"))],
}
