"""Queries that go through the library's interfaces rather than the dialect alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import operators as ops
from brindle.query import Expression, Query
from brindle.sources import load_tables


def variable_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_tables(spark, sf_dir).with_variable("least", 9000.0).with_variable("nation", 3)
    return Query(catalog, "SELECT c_custkey FROM customer WHERE c_acctbal > @least AND c_nationkey = nation").dataframe()


def expression_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = Expression(load_tables(spark, sf_dir), "(SELECT COUNT(*) FROM nation) * 2 + LEN('abc')").evaluate()
    return spark.range(1).select(F.lit(value).cast("long").alias("value"))


def struct_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_tables(spark, sf_dir)
    boxed = catalog.tables["nation"].select("n_nationkey", F.struct("n_name", F.col("n_regionkey").alias("region")).alias("info"))
    return Query(catalog.with_table("boxed", boxed), "SELECT b.n_nationkey, b.info.region AS r, info.n_name.Length AS n FROM boxed b WHERE b.info.region > 1").dataframe()


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_tables(spark, sf_dir).with_function("TWICE", ("int",), "int", "({0} * 2)")
    return Query(catalog, "SELECT n_name, TWICE(n_regionkey) AS t FROM nation").dataframe()


def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_tables(spark, sf_dir).with_aggregate("SPREAD", "double", "CAST(max({0}) - min({0}) AS DOUBLE)")
    return Query(catalog, "SELECT c_nationkey, ROUND(SPREAD(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey").dataframe()


def user_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_tables(spark, sf_dir).with_method("string", "Tail", ("int",), "string", "right({0}, {1})").with_property("string", "Head", "string", "left({0}, 1)")
    return Query(catalog, "SELECT n_name.Tail(2) AS t, n_name.Head AS h FROM nation").dataframe()


def user_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_tables(spark, sf_dir)
    points = catalog.tables["nation"].select("n_nationkey", F.struct(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y")).alias("p"))
    point = points.schema["p"].dataType
    catalog = catalog.with_table("points", points).with_operator("+", (point, point), point, "named_struct('x', {0}.x + {1}.x, 'y', {0}.y + {1}.y)").with_operator("*", (point, "int"), point, "named_struct('x', {0}.x * {1}, 'y', {0}.y * {1})")
    catalog = catalog.with_operator("-", (point,), point, "named_struct('x', -{0}.x, 'y', -{0}.y)").with_operator("=", (point, point), "bool", "({0}.x = {1}.x)").with_conversion(point, "int", "{0}.x")
    return Query(catalog, "SELECT a.n_nationkey, (a.p + b.p * 2).y AS y, (-a.p).x AS x, CAST(b.p AS INT) AS k FROM points a JOIN points b ON a.p = b.p").dataframe()


def verb_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir).tables
    return ops.semi_join(t["nation"], t["supplier"], [("n_nationkey", "s_nationkey")])


def verb_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir).tables
    return ops.anti_join(t["nation"], t["supplier"].filter("s_acctbal > 5000"), [("n_nationkey", "s_nationkey")])


def verb_probe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir).tables
    return ops.probe_join(t["nation"], t["supplier"].filter("s_acctbal > 5000"), [("n_nationkey", "s_nationkey")], "matched").select("n_nationkey", "matched")


def verb_top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir).tables
    return ops.top_with_ties(t["nation"].select("n_name", "n_regionkey"), 4, ["n_regionkey"])


def verb_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir).tables
    edges = t["nation"].filter("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("child"), F.expr("cast((n_nationkey - 1) div 2 as long)").alias("parent"))
    return ops.hierarchy(edges, "child", "parent", roots=spark.range(1).select(F.col("id").alias("child")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (variable_parameter, expression_scalar, struct_property, udf_scalar, udf_aggregate, user_method, user_operator, verb_semi_join, verb_anti_join, verb_probe_join, verb_top_with_ties, verb_hierarchy)
}
ORACLE = {
    "variable_parameter": "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_nationkey = 3",
    "expression_scalar": "SELECT CAST(count(*) * 2 + 3 AS BIGINT) AS value FROM nation",
    "struct_property": "SELECT n_nationkey, n_regionkey AS r, CAST(length(n_name) AS INTEGER) AS n FROM nation WHERE n_regionkey > 1",
    "udf_scalar": "SELECT n_name, n_regionkey * 2 AS t FROM nation",
    "udf_aggregate": "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey",
    "user_method": "SELECT right(n_name, 2) AS t, left(n_name, 1) AS h FROM nation",
    "user_operator": "SELECT n_nationkey, n_regionkey * 3 AS y, -n_nationkey AS x, CAST(n_nationkey AS INTEGER) AS k FROM nation",
    "verb_semi_join": "SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)",
    "verb_anti_join": "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "verb_probe_join": "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS matched FROM nation",
    "verb_top_with_ties": "SELECT n_name, n_regionkey FROM nation QUALIFY rank() OVER (ORDER BY n_regionkey) <= 4",
    "verb_hierarchy": "WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS child, 0 AS level UNION ALL SELECT CAST(n_nationkey AS BIGINT), t.level + 1 FROM nation JOIN t ON n_nationkey > 0 AND (n_nationkey - 1) // 2 = t.child) SELECT child, level FROM t",
}
