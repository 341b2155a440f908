"""Tokens, trees, and what is wrong with a text."""

import datetime as dt

import pytest

from brindle.diagnostics import QueryError
from brindle.dialect import syntax as s
from brindle.dialect.lexer import tokens
from brindle.dialect.parser import parse_expression, parse_query


def values(text):
    return [t.value for t in tokens(text)[:-1]]


def test_numbers():
    assert values("1 2147483648 0FFh 101b 17o 1.5 .5 1e2 1E-1") == [1, 2147483648, 255, 5, 15, 1.5, 0.5, 100.0, 0.1]


def test_strings_dates_names_comments():
    assert values("'it''s' #2020-01-02#") == ["it's", dt.datetime(2020, 1, 2)]
    found = tokens('abc [Order ]] Details] "Exact" -- c\n /* x */ // y\n select')
    assert [(t.kind, t.text, t.exact) for t in found[:-1]] == [("name", "abc", False), ("name", "Order ] Details", False), ("name", "Exact", True), ("word", "SELECT", False)]


@pytest.mark.parametrize(
    ("text", "wrong"),
    [("'abc", "UnterminatedString"), ('"abc', "UnterminatedQuotedIdentifier"), ("[abc", "UnterminatedParenthesizedIdentifier"), ("#2020", "UnterminatedDate"), ("/* x", "UnterminatedComment"), ("#2020-99-99#", "InvalidDate"), ("12x", "InvalidInteger"), ("12b", "InvalidBinary"), ("9o", "InvalidOctal"), ("0xgh", "InvalidHex"), ("0xg", "InvalidInteger"), ("99999999999999999999", "NumberTooLarge"), ("a ; b", "IllegalInputCharacter")],
)
def test_wrong_tokens(text, wrong):
    with pytest.raises(QueryError) as e:
        tokens(text)
    assert e.value.diagnostics[0].id == wrong


def shape(node):
    if isinstance(node, s.Binary):
        return f"({shape(node.left)} {node.op} {shape(node.right)})"
    if isinstance(node, s.Unary):
        return f"({node.op} {shape(node.operand)})"
    if isinstance(node, s.Between):
        return f"({shape(node.operand)} between {shape(node.low)} {shape(node.high)})"
    if isinstance(node, s.IsNull):
        return f"({shape(node.operand)} is null)"
    return str(node.value) if isinstance(node, s.Literal) else node.text


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1 + 2 * 3 ** 4", "(1 + (2 * (3 ** 4)))"),
        ("a OR b AND NOT c = d", "(a OR (b AND (NOT (c = d))))"),
        ("a & b = c", "(a & (b = c))"),
        ("- a * b", "((- a) * b)"),
        ("a - b - c", "((a - b) - c)"),
        ("a BETWEEN 1 AND 2 + 3 AND b", "((a between 1 (2 + 3)) AND b)"),
        ("a LIKE b + c", "(a LIKE (b + c))"),
        ("a NOT LIKE b", "(NOT (a LIKE b))"),
        ("NOT a LIKE b", "((NOT a) LIKE b)"),
        ("a IS NULL = b", "((a is null) = b)"),
        ("a !< b", "(a >= b)"),
    ],
)
def test_binding_powers(text, expected):
    assert shape(parse_expression(text)) == expected


def test_query_tree():
    root = parse_query("WITH t (a) AS (SELECT 1) SELECT DISTINCT TOP 3 WITH TIES x.a b, LEFT('ab', 1) FROM t x LEFT JOIN u ON x.a = u.a WHERE a > 1 GROUP BY a HAVING COUNT(*) > 1 ORDER BY 1 DESC")
    q = root.query.query
    assert (q.distinct, q.top, q.ties, q.tables.kind, len(q.items), root.query.order[0].descending) == (True, 3, True, "LEFT", 2, True)
    assert parse_query("").query is None


def test_intersect_binds_tighter():
    q = parse_query("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3").query
    assert q.kind == "UNION" and q.right.kind == "INTERSECT"


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 FROM", "SELECT (1", "SELECT 1 +", "SELECT a FROM (SELECT 1)", "SELECT CASE END", "SELECT 1 2", "SELECT x IN ()"])
def test_incomplete(text):
    with pytest.raises(QueryError) as e:
        parse_query(text)
    assert e.value.diagnostics[0].id == "TokenExpected"
