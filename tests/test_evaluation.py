"""Values of expressions and rows of queries, against rows known beforehand."""

import math

import pytest

from brindle import operators as ops
from brindle import plans, streaming
from brindle.catalog import Catalog
from brindle.functions.python import format_number, unescape
from brindle.query import Expression, Query
from brindle.sources import from_objects


@pytest.fixture(scope="module")
def catalog(spark):
    staff = [(1, "Nancy", "Davolio", "Seattle", 2), (2, "Andrew", "Fuller", "Tacoma", None), (3, "Janet", "Leverling", "Kirkland", 2), (4, "Margaret", "Peacock", "Redmond", 2), (5, "Steven", "Buchanan", "London", 2), (6, "Michael", "Suyama", "London", 5), (7, "Robert", "King", "London", 5), (8, "Laura", "Callahan", "Seattle", 2), (9, "Anne", "Dodsworth", "London", 5)]
    counts = [2, 7, 4, 3, 7, 5, 10, 4, 7]
    return Catalog(spark).with_tables(
        {
            "Employees": spark.createDataFrame(staff, "EmployeeID int, FirstName string, LastName string, City string, ReportsTo int"),
            "Region": spark.createDataFrame([(1,), (2,), (3,), (4,)], "RegionID int"),
            "EmployeeTerritories": spark.createDataFrame([(e + 1, str(k)) for e, n in enumerate(counts) for k in range(n)], "EmployeeID int, TerritoryID string"),
            "Empty": spark.createDataFrame([], "a int"),
        }
    )


def rows(catalog, text, **kw):
    return [tuple(r) for r in Query(catalog, text, **kw).dataframe().collect()]


VALUES = [
    ("'A' LIKE 'a'", True), ("'ab' LIKE 'a'", False), ("'ab' LIKE 'b'", False), ("'abc' LIKE '_b_'", True), ("'abcde' LIKE '%c%'", True), ("'2.10.1' LIKE '2.1.%'", False), ("'a\\b' LIKE 'a\\_'", True),
    ("SOUNDEX('')", "0000"), ("SOUNDEX('Robert')", "R163"), ("SOUNDEX('Rupert')", "R163"), ("SOUNDEX('Rubin')", "R150"), ("SOUNDEX('Ashcraft')", "A261"), ("SOUNDEX('Ashcroft')", "A261"), ("SOUNDEX('Tymczak')", "T522"),
    ("SOUNDEX('Pfister')", "P236"), ("SOUNDEX('Paella')", "P400"), ("SOUNDEX('Ex Machina')", "E200"), ("SOUNDEX('Ex;Machina')", "E200"), ("'Robert' SOUNDS LIKE 'Rupert'", True),
    ("NULL IS NULL", True), ("1.0 + NULL", None), ("LEN(NULL)", None), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("1.0 / 0.0", math.inf), ("-1.0 / 0.0", -math.inf), ("LOG(0.0)", -math.inf), ("LOG(8.0, 2.0)", 3.0), ("TO_INT32(2.5)", 2), ("TO_INT32(3.5)", 4),
    ("ROUND(2.5)", 3.0), ("TO_STRING(TRUE)", "True"), ("TO_STRING(#2020-01-02 03:04:05#)", "01/02/2020 03:04:05"), ("SUBSTRING('abc', 0, 2)", ""), ("SUBSTRING('abc', 9)", ""), ("CHARINDEX('', 'abc')", 0), ("LPAD('xyz', 2)", "xyz"),
    ("TRIM('\t a \n')", "a"), ("FORMAT(1234.5, 'N1')", "1,234.5"), ("FORMAT(0.256, 'P1')", "25.6 %"), ("FORMAT(255, 'X4')", "00FF"), ("REGEX_UNESCAPE('a\\.b')", "a.b"), ("#2020-01-31#.AddMonths(1).Day", 29), ("(#2020-01-03# - #2020-01-01#).Days", 2),
    ("'abc'.Substring(1)", "bc"), ("'abc'.Length", 3), ("NULLIF(1, 1)", None), ("CASE 3 WHEN 1 THEN 'a' END", None), ("5 & 3 | 8", 9), ("~5", -6), ("1 << 4", 16), ("CAST(2.9 AS INT)", 2), ("TRUE ^ TRUE", False), ("UPPER('a', '')", "A"),
    ("(SELECT LastName FROM Employees WHERE FirstName = 'Margaret')", "Peacock"), ("EXISTS (SELECT * FROM Employees)", True), ("10 >= ALL (SELECT EmployeeID FROM Employees)", True), ("'London' = ANY (SELECT City FROM Employees)", True),
]


@pytest.mark.parametrize(("text", "value"), VALUES, ids=[v[0] for v in VALUES])
def test_values(catalog, text, value):
    assert Expression(catalog, text).evaluate() == value


def test_subqueries(catalog):
    assert rows(catalog, "SELECT EmployeeID FROM Employees WHERE EmployeeID NOT IN (1, 2, 3) ORDER BY 1") == [(n,) for n in range(4, 10)]
    assert rows(catalog, "SELECT EmployeeID, ReportsTo FROM Employees WHERE ReportsTo IN (SELECT RegionID FROM Region) ORDER BY 1") == [(1, 2), (3, 2), (4, 2), (5, 2), (8, 2)]
    assert rows(catalog, "SELECT EmployeeID, ReportsTo FROM Employees WHERE ReportsTo NOT IN (SELECT RegionID FROM Region) ORDER BY 1") == [(6, 5), (7, 5), (9, 5)]
    counted = rows(catalog, "SELECT e.EmployeeID, (SELECT COUNT(*) FROM EmployeeTerritories t WHERE t.EmployeeID = e.EmployeeID) FROM Employees e ORDER BY e.EmployeeID")
    assert [r[1] for r in counted] == [2, 7, 4, 3, 7, 5, 10, 4, 7]
    assert rows(catalog, "SELECT NULL = ANY (SELECT RegionID FROM Region) AS a, 1 NOT IN (SELECT NULLIF(RegionID, 2) FROM Region) AS b, NULL NOT IN (SELECT a FROM Empty) AS c") == [(False, False, True)]


def test_scalar_subquery_of_many_rows_fails(catalog):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        Expression(catalog, "(SELECT RegionID FROM Region)").evaluate()


def test_recursion_limit(catalog):
    counter = "WITH t (n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM t WHERE n < {}) SELECT COUNT(*) FROM t"
    assert rows(catalog, counter.format(100)) == [(101,)]
    with pytest.raises(Exception, match="RECURSION"):
        rows(catalog, counter.format(101))


def test_recursion_beyond_a_million_rows(spark):
    edges = spark.range(1, 1_200_001).selectExpr("id as child", "cast(0 as long) as parent")
    assert ops.hierarchy(edges, "child", "parent", spark.range(1).toDF("child")).count() == 1_200_001
    c = Catalog(spark).with_table("E", edges)
    assert rows(c, "WITH t (n) AS (SELECT TO_INT64(0) UNION ALL SELECT e.child FROM E e JOIN t ON e.parent = t.n) SELECT COUNT(*) FROM t") == [(1_200_001,)]


def test_no_forced_broadcasts(spark, small):
    from brindle.queries import QUERIES

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("sub_not_in", "sub_not_in_with_null", "sub_not_in_null_operand", "sub_not_in_nothing", "sub_not_in_correlated", "sub_any", "sub_all", "sub_some", "sub_any_all_nulls", "sub_all_correlated"):
            plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Cartesian" not in plan, (name, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_typed_reader(spark):
    import datetime as dt

    c = Catalog(spark).with_table("t", spark.createDataFrame([(1, "x", 1.5, None, True, dt.datetime(2020, 1, 2), bytearray(b"abc"))], "i int, S string, d double, n int, b boolean, w timestamp_ntz, z binary"))
    with Query(c, "SELECT * FROM t").typed_reader() as r:
        with pytest.raises(RuntimeError):
            r.value(0)
        assert r.read() and r.field_count == 7 and r.name(1) == "S" and r.ordinal("s") == 1 and r.type_name(0) == "int"
        assert (r.int32("i"), r.byte(0), r.string("S"), r.char(1), r.double("D"), r.boolean("b"), r.datetime("w").year, r.blob("z", 1)) == (1, 1, "x", "x", 1.5, True, 2020, b"bc")
        assert r.is_null("n") and r["i"] == 1 and r.values()[0] == 1
        for get in (lambda: r.int32("n"), lambda: r.string("i"), lambda: r.int32("d"), lambda: r.boolean("i")):
            with pytest.raises(TypeError):
                get()
        with pytest.raises(IndexError):
            r.value("nope")
        assert not r.read()


def test_catalog_removals(spark):
    from brindle.catalog import ForeignKey, Provider

    class Lengths(Provider):
        def properties(self, kind):
            return {"Twice": ("string", "concat({0}, {0})")} if kind == "string" else {}

        def methods(self, kind):
            return {"Plus": (("string",), "string", "concat({0}, {1})")} if kind == "string" else {}

    lengths = Lengths()
    full = Catalog(spark).with_table("t", spark.createDataFrame([(1, "x")], "a int, s string")).with_variable("v", 1).with_function("F", ("int",), "int", "{0} + 1").with_aggregate("G", "int", "max({0})").with_property("string", "P", "int", "1").with_method("string", "M", (), "int", "2").with_comparer("binary", "hex({0})").with_provider(lengths)
    full = full.with_relation(ForeignKey("t", ("a",), "t", ("a",)))
    assert rows(full, "SELECT s.Twice AS a, s.Plus('y') AS b, F(v) AS c, s.P AS d, s.M() AS e FROM t") == [("xx", "xy", 2, 1, 2)]
    assert rows(full, "SELECT G(a) AS g FROM t") == [(1,)]
    bare = full.without_variable("v").without_function("f").without_aggregate("g").without_property("string", "p").without_method("string", "m").without_comparer("binary").without_provider(lengths).without_relation(full.relations[0])
    assert not any((bare.variables, bare.functions, bare.aggregates, bare.properties, bare.methods, bare.comparers, bare.providers, bare.relations))
    with pytest.raises(KeyError):
        bare.without_variable("v")
    full.close()
    assert not [t for t in spark.catalog.listTables() if t.name in full._views.values()]


def test_native_masks_equal_the_function(spark):
    values = [0.0, 1.0, -1.0, 0.5, 2.5, 1234.565, -1234567.891, 0.004, 12.0, 99.995]
    masks = ["N2", "N0", "F1", "F3", "P1", "E2", "E3", "#,##0.00", "0.##", "000", "#.0#", "#,#00"]
    c = Catalog(spark).with_table("t", spark.createDataFrame([(v,) for v in values], "v double"))
    q = Query(c, "SELECT v, " + ", ".join(f"FORMAT(v, '{m}') AS m{i}" for i, m in enumerate(masks)) + " FROM t")
    assert "brindle_format" not in q.sql()
    for row in q.dataframe().collect():
        for m, got in zip(masks, row[1:], strict=True):
            assert got.replace("-0.00", "0.00").replace("-0.0", "0.0") == format_number(row[0], m).replace("-0.00", "0.00").replace("-0.0", "0.0"), (row[0], m)
    q = Query(c, "SELECT TOP 1 FORMAT(-7, 'D3') AS a, FORMAT(255, 'x') AS b, FORMAT(12.0, '$#.#!') AS c, REGEX_UNESCAPE('a\\.b') AS d FROM t")
    assert [tuple(r) for r in q.dataframe().collect()] == [("-007", "ff", "$12!", "a.b")]


def test_strict_mode(catalog):
    text = "SELECT AVG(EmployeeID * 2 + 1) AS a, NULLIF(1, NULL) AS n, VAR(ReportsTo) AS v FROM Employees"
    assert rows(catalog, "SELECT AVG(RegionID) AS a FROM Region", strict=True) == [(2,)]
    assert rows(catalog, "SELECT AVG(RegionID) AS a FROM Region") == [(2.5,)]
    assert rows(catalog, text, strict=True)[0][1] is None and rows(catalog, text)[0][1] == 1


def test_sinks(catalog):
    q = Query(catalog, "SELECT RegionID, RegionID + 1, RegionID * 2 FROM Region WHERE RegionID < 3 ORDER BY 1")
    assert q.dataframe().columns == ["RegionID", "Column", "Column1"]
    assert [tuple(r) for r in q.reader()] == [(1, 2, 2), (2, 3, 4)]
    assert q.schema_reader().count() == 0 and q.scalar() == 1 and q.table().num_rows == 2
    assert [r.REGIONID for r in q.dynamic_rows()] == [1, 2]
    assert Query(catalog, "").dataframe().count() == 0
    assert Query(catalog, "SELECT RegionID FROM Region WHERE RegionID > 9").scalar() is None


def test_user_defined(catalog):
    more = catalog.with_function("HALF", ("int",), "double", lambda x: x / 2.0).with_aggregate("RANGE", "int", lambda x: int(x.max() - x.min())).with_comparer("binary", "hex({0})")
    assert rows(more, "SELECT HALF(RegionID) AS h FROM Region WHERE RegionID = 3") == [(1.5,)]
    assert rows(more, "SELECT RANGE(RegionID) AS r FROM Region") == [(3,)]


def test_verbs(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (3,), (None,)], "b int")
    on = [("a", "b")]
    assert [r.a for r in ops.semi_join(left, right, on).collect()] == [2]
    assert sorted((r.a or 0) for r in ops.anti_join(left, right, on).collect()) == [0, 1]
    assert sorted((r.a or 0, r.hit) for r in ops.probe_join(left, right, on, "hit").collect()) == [(0, False), (1, False), (2, True)]
    ties = spark.createDataFrame([(x,) for x in (1, 2, 3, 3, 4)], "x int")
    assert [r.x for r in ops.top_with_ties(ties, 3, ["x"]).collect()] == [1, 2, 3, 3]
    assert ops.top_with_ties(ties, 0, ["x"]).count() == 0
    nulls = spark.createDataFrame([(None,), (1,), (2,), (1,)], "x int")
    assert [r.x for r in ops.distinct_sorted(nulls, ["-x"]).collect()] == [None, 2, 1]
    assert sorted((r.x or 0) for r in ops.intersect_rows(nulls, nulls).collect()) == [0, 1, 2]
    assert ops.except_rows(nulls, nulls).count() == 0 and ops.union_rows(ties, ties, distinct=True).count() == 4
    assert ops.asserted(ties, ties.x > 0, "positive").count() == 5
    with pytest.raises(Exception, match="too large"):
        ops.asserted(ties, ties.x < 4, "too large").collect()
    texts = spark.createDataFrame([("a", " y "), ("a", "x"), ("a", "y"), ("b", None)], "k string, v string")
    assert sorted(map(tuple, ops.concat_aggregate(texts, ["k"], "v", "all").collect())) == [("a", "x, y"), ("b", "")]


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL"])
def test_join_kinds(spark, kind):
    c = Catalog(spark).with_tables({"a": spark.createDataFrame([(1,), (2,), (None,)], "x int"), "b": spark.createDataFrame([(2,), (3,), (None,)], "y int")})
    found = set(rows(c, f"SELECT x, y FROM a {kind} JOIN b ON x = y"))
    assert found == {(2, 2)} | ({(1, None), (None, None)} if kind in ("LEFT", "FULL") else set()) | ({(None, 3), (None, None)} if kind in ("RIGHT", "FULL") else set())


def test_objects_plans_streams(spark, tmp_path):
    from dataclasses import dataclass

    @dataclass
    class Item:
        Id: int
        Name: str

    items = from_objects(spark, [Item(1, "One"), Item(42, "Two")])
    c = Catalog(spark).with_table("Items", items)
    q = Query(c, "SELECT Name FROM Items WHERE Id > 5")
    assert q.scalar() == "Two"
    assert [s.name for s in plans.steps(q)] == ["parsed", "analyzed", "optimized", "physical"] and "Filter" in plans.explain(q)
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = Query(Catalog(spark).with_table("Items", stream), "SELECT Id * 2 AS twice FROM Items WHERE Name LIKE 't%'")
    assert streaming.is_streaming(q)
    streaming.start(q, "twice", str(tmp_path / "check")).awaitTermination(60)
    assert spark.table("twice").collect()[0][0] == 84


def test_pushdown(spark, small):
    from brindle.sources import load_tables

    plan = plans.explain(Query(load_tables(spark, small), "SELECT l_orderkey FROM lineitem WHERE l_quantity > 40.0"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_python_functions():
    assert [format_number(*a) for a in [(1234.567, "#,##0.00"), (0.5, "0.##"), (-3, "000"), (1234.5, "E2"), (7, "D3"), (12.0, "$#.#!")]] == ["1,234.57", "0.5", "-003", "1.23E+003", "007", "$12!"]
    assert unescape(r"a\.b\tc\x41") == "a.b\tcA"
