"""Connected components of a graph whose edges do not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import removed, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hung(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each neighbour b of a hung on the smallest of a and its neighbours.

    The minimum is a pre-aggregated sum and comes back by a join, which is
    split where one a is hot; a window over a would hold its rows together.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("k"))
    if larger_only:
        kept = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return kept.filter("a > b").distinct()


def components(edges: DataFrame, at_once: int = 2) -> DataFrame:
    """Of edges (a, b: longs) the table node, component: the smallest node reachable.

    Alternates large stars (a node's larger neighbours move to its smallest)
    and small stars (its smaller ones and itself do) until nothing moves; the
    edges then are stars around each component's smallest node. Rounds grow
    with the logarithm of the nodes. Each round is written to the shared folder
    and the round before it deleted. Self-loops and repeated edges are
    harmless; nodes without an edge have no row. at_once: rounds that are one
    plan; plans grow eightfold with each, and the driver's memory with them.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    while True:
        # By default two rounds are one plan: the first's result is small beside the cost of a write.
        new = now
        for _ in range(at_once):
            new = _hung(_hung(_both_ways(new), True), False)
        new = written(new, "edges")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(now)
        now = new
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
