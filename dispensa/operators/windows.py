"""Ordered work inside a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ranked(df: DataFrame, key: str, order: list) -> DataFrame:
    """A key's first row by an order that ends in a tie key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def number_parts(df: DataFrame, keys: list[str], order: list, out: str = "no", start: int = 0) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1))


def carry_forward(df: DataFrame, key: str, pos: str, value: Column, out: str) -> DataFrame:
    """The last value that is not null, up to each row."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def between_markers(df: DataFrame, key: str, pos: str, line: str, start: Column, end: Column) -> DataFrame:
    """Lines after the first start marker and before the next end marker; without a start all lines that are not blank."""
    w = Window.partitionBy(key)
    first = F.min(F.when(start, F.col(pos))).over(w)
    one = df.withColumn("__s", first)
    two = one.withColumn("__e", F.min(F.when(end & (F.col(pos) > F.col("__s")), F.col(pos))).over(w))
    inside = (F.col(pos) > F.col("__s")) & (F.col("__e").isNull() | (F.col(pos) < F.col("__e")))
    return two.where(F.when(F.col("__s").isNotNull(), inside).otherwise(F.trim(line) != "")).drop("__s", "__e")


def first_and_sum(df: DataFrame) -> DataFrame:
    """From (place, term, pos, n, text, priority): one row per place and term with the count summed and the first excerpt."""
    return df.groupBy("place", "term").agg(F.sum("n").alias("n"), F.min_by("text", "pos").alias("text"), F.min("priority").alias("priority"))


def unique_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key nothing else has."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__n = 1").drop("__n")
