from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Keys = Sequence[tuple[str, str]]


def _order(keys: Sequence[str]) -> list[Column]:
    """Sort keys ("-name": descending); nulls come first either way."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys]


def _matches(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    found = None
    for a, b in keys:
        one = left[a] == right[b]
        found = one if found is None else found & one
    return found if found is not None else F.lit(True)


def sorted_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*_order(keys))


def distinct_sorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each combination of the keys (nulls alike), in their order."""
    return df.dropDuplicates([k.lstrip("-") for k in keys]).orderBy(*_order(keys))


def top(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*_order(keys)) if keys else df).limit(n)


def top_with_ties(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The first n rows and those equal to the last of them on all keys.

    Spark applies a bound on a rank within each partition before the shuffle,
    so that no more than n rows and ties of each meet in one task.
    """
    if not keys:
        raise ValueError("ties need sort keys")
    ranked = df.withColumn("__rank", F.rank().over(Window.orderBy(*_order(keys))))
    return ranked.filter(F.col("__rank") <= n).drop("__rank").orderBy(*_order(keys))


def semi_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of left with a match, once each."""
    return left.join(right, _matches(left, right, keys), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of left without a match; a null key matches nothing."""
    return left.join(right, _matches(left, right, keys), "left_anti")


def probe_join(left: DataFrame, right: DataFrame, keys: Keys, name: str) -> DataFrame:
    """All rows of left, and whether each has a match."""
    marks = right.select(*(F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys))).distinct().withColumn("__hit", F.lit(True))
    joined = left.join(marks, _matches(left, marks, [(a, f"__k{i}") for i, (a, _) in enumerate(keys)]), "left")
    return joined.withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit", *(f"__k{i}" for i in range(len(keys))))


def union_rows(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """By position; names are the first's."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out.distinct() if distinct else out


def intersect_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows in both, nulls alike."""
    return left.intersect(right)


def except_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of left that are not in right, nulls alike."""
    return left.subtract(right)


def asserted(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df; when it runs, a row that does not meet the condition stops it with the message."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def concat_aggregate(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Of each group the distinct trimmed texts of a column, sorted, joined by ", "; empty if there are none."""
    text = F.trim(F.col(column).cast("string"))
    return df.groupBy(*by).agg(F.concat_ws(", ", F.array_sort(F.collect_set(text))).alias(name))


def lift_row_limit(spark: SparkSession) -> None:
    """Lets recursive queries of a session have any number of rows; Spark's own limit is a million, unless one was set. Levels stay limited."""
    name = "spark.sql.cteRecursionRowLimit"
    if spark.conf.get(name) == "1000000":
        spark.conf.set(name, "-1")


def hierarchy(edges: DataFrame, child: str, parent: str, roots: DataFrame, limit: int = 100) -> DataFrame:
    """Nodes reachable from roots (one column, named child) with their level, by a recursive query of up to limit levels."""
    spark = edges.sparkSession
    lift_row_limit(spark)
    edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).createOrReplaceTempView("brindle_edges")
    roots.select(F.col(child).alias("c")).createOrReplaceTempView("brindle_roots")
    return spark.sql(
        f"WITH RECURSIVE t(c, level) MAX RECURSION LEVEL {limit + 1} AS ((SELECT c, 0 FROM brindle_roots) UNION ALL (SELECT e.c, t.level + 1 FROM brindle_edges e JOIN t ON e.p = t.c)) SELECT c, level FROM t"
    ).toDF(child, "level")
