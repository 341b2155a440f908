"""Names, types and what the binder reports."""

import itertools

import pytest

from brindle.catalog import Catalog, ForeignKey
from brindle.dialect import types as ty
from brindle.dialect.binder import Binder
from brindle.functions.registry import Bound
from brindle.query import Expression, Query


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([(1, "One"), (2, "Two")], "Id int, Name string")
    u = spark.createDataFrame([(1, 10, bytearray(b"x"))], "Id int, Value int, Data binary")
    return Catalog(spark).with_tables({"T": t, "U": u}).with_variable("v", 5)


CASES = [
    ("SELECT x FROM T", "ColumnTableOrVariableNotDeclared"),
    ("SELECT * FROM nope", "UndeclaredTable"),
    ("SELECT T.x FROM T", "UndeclaredColumn"),
    ("SELECT z.* FROM T", "UndeclaredTableInstance"),
    ("SELECT @nope", "UndeclaredVariable"),
    ("SELECT NOPE(1)", "UndeclaredFunction"),
    ("SELECT LEN(1, 2)", "UndeclaredFunction"),
    ("SELECT Name.Nope FROM T", "UndeclaredProperty"),
    ("SELECT Name.Nope() FROM T", "UndeclaredMethod"),
    ("SELECT CAST(1 AS NOPE)", "UndeclaredType"),
    ("SELECT CAST('1' AS INT)", "CannotConvert"),
    ("SELECT Id FROM T, U", "AmbiguousColumnRef"),
    ("SELECT T FROM T", "InvalidRowReference"),
    ("SELECT LEN FROM T", "InvocationRequiresParenthesis"),
    ("SELECT 'a' * 2", "CannotApplyBinaryOperator"),
    ("SELECT -'a'", "CannotApplyUnaryOperator"),
    ("SELECT NOT 1", "CannotApplyUnaryOperator"),
    ("SELECT CASE WHEN 1 THEN 2 END", "WhenMustEvaluateToBool"),
    ("SELECT CASE WHEN TRUE THEN 1 ELSE 'a' END", "CannotConvert"),
    ("SELECT *", "MustSpecifyTableToSelectFrom"),
    ("SELECT COUNT(COUNT(Id)) FROM T", "AggregateCannotContainAggregate"),
    ("SELECT SUM((SELECT 1)) FROM T", "AggregateCannotContainSubquery"),
    ("SELECT Id FROM T GROUP BY (SELECT 1)", "GroupByCannotContainSubquery"),
    ("SELECT SUM(Name) FROM T", "AggregateDoesNotSupportType"),
    ("SELECT Id FROM T WHERE COUNT(*) > 1", "AggregateInWhere"),
    ("SELECT T.Id FROM T JOIN U ON COUNT(*) > 1", "AggregateInOn"),
    ("SELECT 1 FROM T GROUP BY COUNT(*)", "AggregateInGroupBy"),
    ("SELECT 1 FROM T, t", "DuplicateTableRefInFrom"),
    ("SELECT TOP 1 WITH TIES Id FROM T", "TopWithTiesRequiresOrderBy"),
    ("SELECT Id FROM T ORDER BY 2", "OrderByColumnPositionIsOutOfRange"),
    ("SELECT Id FROM T ORDER BY 'a'", "ConstantExpressionInOrderBy"),
    ("SELECT Id FROM T WHERE Id", "WhereClauseMustEvaluateToBool"),
    ("SELECT T.Id FROM T JOIN U ON T.Id", "OnClauseMustEvaluateToBool"),
    ("SELECT Id FROM T GROUP BY Id HAVING Id", "HavingClauseMustEvaluateToBool"),
    ("SELECT Id, COUNT(*) FROM T", "SelectExpressionNotAggregatedAndNoGroupBy"),
    ("SELECT Name, COUNT(*) FROM T GROUP BY Id", "SelectExpressionNotAggregatedOrGrouped"),
    ("SELECT Id FROM T GROUP BY Id HAVING Name = 'a'", "HavingExpressionNotAggregatedOrGrouped"),
    ("SELECT COUNT(*) FROM T ORDER BY Id", "OrderByExpressionNotAggregatedAndNoGroupBy"),
    ("SELECT Id FROM T GROUP BY Id ORDER BY Name", "OrderByExpressionNotAggregatedOrGrouped"),
    ("SELECT DISTINCT Data FROM U", "InvalidDataTypeInSelectDistinct"),
    ("SELECT 1 FROM U GROUP BY Data", "InvalidDataTypeInGroupBy"),
    ("SELECT Id FROM U ORDER BY Data", "InvalidDataTypeInOrderBy"),
    ("SELECT Data FROM U UNION SELECT Data FROM U", "InvalidDataTypeInUnion"),
    ("SELECT Data FROM U EXCEPT SELECT Data FROM U", "InvalidDataTypeInExcept"),
    ("SELECT Data FROM U INTERSECT SELECT Data FROM U", "InvalidDataTypeInIntersect"),
    ("SELECT 1, 2 UNION SELECT 1", "DifferentExpressionCountInBinaryQuery"),
    ("SELECT Id FROM T UNION SELECT Id FROM U ORDER BY Name", "OrderByItemsMustBeInSelectListIfUnionSpecified"),
    ("SELECT DISTINCT Id FROM T ORDER BY Name", "OrderByItemsMustBeInSelectListIfDistinctSpecified"),
    ("SELECT Id FROM T WHERE Id IN (SELECT Id, Name FROM T)", "TooManyExpressionsInSelectListOfSubquery"),
    ("SELECT 1 + ALL (SELECT 1)", "InvalidOperatorForAllAny"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "NoColumnAliasSpecified"),
    ("WITH x (a) AS (SELECT 1, 2) SELECT * FROM x", "CteHasMoreColumnsThanSpecified"),
    ("WITH x (a, b) AS (SELECT 1) SELECT * FROM x", "CteHasFewerColumnsThanSpecified"),
    ("WITH x (a, A) AS (SELECT 1, 2) SELECT * FROM x", "CteHasDuplicateColumnName"),
    ("WITH x AS (SELECT 1 a), x AS (SELECT 2 a) SELECT * FROM x", "CteHasDuplicateTableName"),
    ("WITH x (a) AS (SELECT a FROM x) SELECT * FROM x", "CteDoesNotHaveUnionAll"),
    ("WITH x (a) AS (SELECT a FROM x UNION ALL SELECT 1) SELECT * FROM x", "CteDoesNotHaveAnchorMember"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT a FROM x UNION ALL SELECT 2) SELECT * FROM x", "CteContainsUnexpectedAnchorMember"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT p.a FROM x p, x q) SELECT * FROM x", "CteContainsMultipleRecursiveReferences"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT DISTINCT a FROM x) SELECT * FROM x", "CteContainsDistinct"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT TOP 1 a FROM x) SELECT * FROM x", "CteContainsTop"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT x.a FROM x LEFT JOIN T ON T.Id = x.a) SELECT * FROM x", "CteContainsOuterJoin"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT MAX(a) FROM x) SELECT * FROM x", "CteContainsGroupByHavingOrAggregate"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT 1 FROM T WHERE EXISTS (SELECT * FROM x)) SELECT * FROM x", "CteContainsRecursiveReferenceInSubquery"),
    ("WITH x (a) AS (SELECT 1 UNION ALL SELECT a + 0.5 FROM x) SELECT * FROM x", "CteHasTypeMismatchBetweenAnchorAndRecursivePart"),
]


@pytest.mark.parametrize(("text", "wrong"), CASES, ids=[c[1] for c in CASES])
def test_diagnostics(catalog, text, wrong):
    assert [d.id for d in Query(catalog, text).diagnostics()] == [wrong]


def test_ambiguous(spark, catalog):
    boxed = spark.createDataFrame([((1, 2),)], "p struct<a: int, A: int>")
    point = boxed.schema["p"].dataType
    c = catalog.with_table("B", boxed).with_variable("V", 6).with_aggregate("G", "int", "max({0})").with_aggregate("g", "int", "min({0})")
    c = c.with_operator("+", (point, "double"), "int", "1").with_operator("+", (point, "decimal"), "int", "2").with_conversion(point, "int", "1").with_conversion(point, "int", "2")
    cases = {"SELECT @v": "AmbiguousVariable", "SELECT v": "AmbiguousReference", "SELECT p.a FROM B": "AmbiguousProperty", "SELECT G(1)": "AmbiguousAggregate", "SELECT p + 1 FROM B": "AmbiguousBinaryOperator", "SELECT CAST(p AS INT) FROM B": "AmbiguousConversion"}
    assert {t: [d.id for d in Query(c, t).diagnostics()] for t in cases} == {t: [w] for t, w in cases.items()}
    assert Query(c, "SELECT p + 1.5 AS x FROM B").scalar() == 1
    assert Query(c.without_aggregate("G"), "SELECT G(1)").diagnostics()[0].id == "UndeclaredFunction"
    with pytest.raises(ValueError, match="AggregateInvalidInCurrentContext"):
        Expression(catalog, "COUNT(*)").evaluate()
    wrong = Query(catalog, "SELECT 1 FROM (T JOIN T y ON T.Id = y.Id) FULL JOIN U ON EXISTS (SELECT 1 FROM T x WHERE x.Id = T.Id AND x.Id = U.Id)")
    assert [d.id for d in wrong.diagnostics()] == ["UnsupportedSubqueryInOn"]
    with pytest.raises(ValueError, match="UnsupportedCulture"):
        Expression(catalog, "TO_STRING(1.5, 'xx-XX')").evaluate()


def test_names(catalog):
    assert Query(catalog, 'SELECT "Id" FROM T').diagnostics() == []
    assert Query(catalog, 'SELECT "id" FROM T').diagnostics() != []
    assert Query(catalog, "SELECT [id], t.NAME FROM t").columns() == [("id", "int"), ("NAME", "string")]
    assert Query(catalog, "SELECT v + 1 AS w, @v FROM T").columns() == [("w", "int"), ("", "int")]


WIDTH = ["int", "uint", "long", "ulong", "float", "double"]


def expected(a, b):
    """The promotion rule, stated the other way round: the first type both convert to."""
    a, b = ("int" if t in ty.SMALL else t for t in (a, b))
    if "decimal" in (a, b):
        return "double" if {a, b} & {"float", "double"} else "decimal"
    if "ulong" in (a, b) and {a, b} & {"int", "long"}:
        return "decimal"
    if {a, b} == {"int", "uint"}:
        return "long"
    return max(a, b, key=WIDTH.index)


@pytest.mark.parametrize(("a", "b"), list(itertools.product(sorted(ty.NUMERIC), repeat=2)))
def test_type_matrix(catalog, a, b):
    binder, x, y = Binder(catalog), Bound("x", a), Bound("y", b)
    wide = expected(a, b)
    for op in "+-*/%":
        assert binder.operate(op, x, y, 0)[1] == wide
    assert binder.operate("**", x, y, 0)[1] == "double"
    for op in ("=", "<", ">="):
        assert binder.operate(op, x, y, 0)[1] == "bool"
    if wide in ty.INTEGERS:
        assert binder.operate("&", x, y, 0)[1] == wide
    else:
        with pytest.raises(ValueError, match="CannotApplyBinaryOperator"):
            binder.operate("&", x, y, 0)


def test_expression_types(catalog):
    for text, kind in [("1 + 2.5", "double"), ("'a' + 1", "string"), ("1 < 2", "bool"), ("NULL", "null"), ("#2020-01-02# - #2020-01-01#", "timespan"), ("COALESCE(NULL, 1, 2.0)", "double"), ("1 / 2", "int")]:
        assert Expression(catalog, text).type == kind
    with pytest.raises(ValueError, match="CannotConvert"):
        Expression(catalog, "'a'", target="int").evaluate()


def test_catalog_is_immutable(catalog):
    more = catalog.with_variable("w", None, "int").without_table("U")
    assert "w" not in catalog.variables and "U" in catalog.tables and "U" not in more.tables
    assert Expression(more, "@w + 1", default=7).evaluate() == 7
    with pytest.raises(TypeError):
        catalog.with_variable("x", "text", "int")
    related = catalog.with_relation(ForeignKey("T", ("Id",), "U", ("Id",)))
    assert len(related.relations) == 1 and related.without_table("T").relations == ()
    with pytest.raises(ValueError, match="no column"):
        catalog.with_relation(ForeignKey("T", ("x",), "U", ("Id",)))
