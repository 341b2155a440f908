"""Relational verbs on DataFrames, for what the DataFrame API has no word for. All are built of Spark's own operators."""

from brindle.operators.relational import (
    anti_join,
    asserted,
    concat_aggregate,
    distinct_sorted,
    except_rows,
    hierarchy,
    intersect_rows,
    probe_join,
    semi_join,
    sorted_by,
    top,
    top_with_ties,
    union_rows,
)

__all__ = ["anti_join", "asserted", "concat_aggregate", "distinct_sorted", "except_rows", "hierarchy", "intersect_rows", "probe_join", "semi_join", "sorted_by", "top", "top_with_ties", "union_rows"]
