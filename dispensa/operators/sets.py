"""Set operations on ids and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def changed(old: Column, new: Column) -> Column:
    """Whether two arrays differ as sets; a missing one is empty."""
    a, b = F.coalesce(old, F.array()), F.coalesce(new, F.array())
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def merge_lists(a: Column, b: Column) -> Column:
    """Entries of both in order of first appearance."""
    return F.array_distinct(F.concat(a, b))


def except_keys(a: DataFrame, b: DataFrame, key: str, other: str) -> DataFrame:
    return a.join(b.select(F.col(other).alias("__k")), a[key] == F.col("__k"), "left_anti")
