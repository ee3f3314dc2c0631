"""Counts, facets, ordered lists and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import non_blank


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()])


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.where(non_blank(column)).agg(F.countDistinct(column).alias("n"))


def distinct_elements(df: DataFrame, array: str) -> DataFrame:
    return distinct_count(df.select(F.explode(array).alias("x")), "x")


def top_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts per value, largest first, ties by value."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out if k is None else out.limit(k)


def top_linked(df: DataFrame, array: str, dim: DataFrame, dim_key: str, label: str, k: int = 20, placeholder: str = "(unknown)") -> DataFrame:
    """The k elements of an array column in most rows, with their labels; unknown ones keep a placeholder. Labels are joined to k rows only."""
    counts = df.select(F.explode(array).alias(dim_key)).groupBy(dim_key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), dim_key).limit(k)
    return dim.select(dim_key, F.col(label).alias("label")).join(F.broadcast(counts), dim_key, "right").select(dim_key, "n", F.coalesce("label", F.lit(placeholder)).alias("label"))


def count_by_key_part(df: DataFrame, key: str, i: int) -> DataFrame:
    return df.groupBy(F.get(F.split(key, r"\|"), F.lit(i)).alias("part")).agg(F.count("*").alias("n"))


def cond_counts(df: DataFrame, **tests: Column) -> DataFrame:
    """Rows that meet each test, in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


def count_labels(df: DataFrame, array: str, labels: dict[str, str], keep_zero: bool = True) -> DataFrame:
    """Rows for each label whose pattern an element matches; a row may count for several. One pass: a label list is a few patterns."""
    def hit(pattern: str) -> Column:
        return F.exists(array, lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))

    flags = df.agg(*[F.count_if(hit(p)).alias(n) for n, p in labels.items()])
    out = flags.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in labels]), F.array(*[F.col(f"`{n}`") for n in labels]))).alias("label", "n"))
    return out if keep_zero else out.where("n > 0")


def facets(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """(facet, value, n): distinct values of several columns that are not blank and have ``least`` characters, from one scan."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))).alias("facet", "value"))
    return long.where(non_blank("value") & (F.length("value") >= least)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def group_sorted(df: DataFrame, key: str, order: list[Column], fields: list[str], out: str = "items") -> DataFrame:
    """A key's records as one ordered list; the order must end in a tie key."""
    rows = F.struct(*[c.alias(f"__o{k}") for k, c in enumerate(order)], *fields)
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(rows)), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))


def ordered_unique(df: DataFrame, key: str, value: str, test: Column, order: list[str]) -> DataFrame:
    """Values of the rows that meet a test, in order, each once."""
    rows = F.collect_list(F.when(test, F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["__v"])).alias("labels"))


def latest_by(df: DataFrame, key: str, when: str, tie: str, value: str) -> DataFrame:
    """The value of a key's latest record, if it has one with a date."""
    return df.groupBy(key).agg(F.max_by(value, F.when(F.col(when).isNotNull(), F.struct(when, tie))).alias("latest"), (F.count(when) > 0).alias("has_any"))


def rollup_nested(df: DataFrame, key: str, order: list[str], fields: list[str], **tests: Column) -> DataFrame:
    """Per key: number of associations, conditional counters, and the nested list."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in tests.items()], F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("items"))


def rollup_parts(df: DataFrame, key: str, order: list[str], fields: list[str], most: int = 1000, **tests: Column) -> DataFrame:
    """(key, n, conditional counters, part, items): the nested list of a key in parts of at most ``most`` items, numbered from 0; the counters are the key's.

    Keys are counted first, and a key with more rows is dealt by hash to as many lots as its count is worth; a lot is cut into parts of
    ``most`` in its order. So no list and no task grows with a key. Null keys are left out; ``order`` and ``key`` name unique rows.
    """
    rows = df.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in tests.items()])
    large = counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("__lots"))  # a row for each key that is worth several lists
    dealt = rows.join(large, key, "left").withColumn("__lot", F.pmod(F.xxhash64(*order), F.coalesce("__lots", F.lit(1))).cast("int"))
    place = F.row_number().over(Window.partitionBy(key, "__lot").orderBy(*order)) - 1
    lists = dealt.withColumn("__cut", F.floor(place / most)).groupBy(key, "__lot", "__cut").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("items"))
    first = Window.partitionBy(key).orderBy("__lot", "__cut")
    return lists.withColumn("part", F.row_number().over(first) - 1).join(counts, key).select(key, "n", *tests, "part", "items")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(source, n): rows that carry each optional column, most first."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "source", "n").orderBy(F.desc("n"), "source")


def set_append(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values as a sorted set, values as a sorted list)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("as_set"), F.array_sort(F.collect_list(value)).alias("as_list"))


def dedup_by_hash(items: Column, hash_of) -> Column:
    """Entries of an array whose hash no entry before has; those without a hash all stay."""
    hashes = F.transform(items, hash_of)
    kept = F.transform(items, lambda x, i: F.when(F.get(hashes, i).isNull() | (F.array_position(hashes, F.get(hashes, i)) == i + 1), x))
    return F.filter(kept, lambda x: x.isNotNull())


def distinct_ids(df: DataFrame, key: str, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.countDistinct(key).alias("ids"), F.count("*").alias("n"))


def chunks_by_kind(ids: DataFrame, chunks: DataFrame, key: str, kind: str, order: list[str], item: str, cap: int | None = None) -> DataFrame:
    """(key, kind, items): raw entries of the wanted keys by kind, in order, at most ``cap`` of each on request."""
    lists = chunks.join(ids.select(key).distinct(), key, "left_semi").groupBy(key, kind).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__i")))), lambda x: x["__i"]).alias("items"))
    return lists if cap is None else lists.withColumn("items", F.slice("items", 1, cap))


def compute_sources(market: DataFrame, medicines: DataFrame, substances: DataFrame, names: DataFrame) -> DataFrame:
    """(market_id, tags): own source, documents, sources of linked substances, known names; sorted, each once."""
    items = medicines.select("medicine_id", F.explode("refs").alias("substance_id")).join(substances, "substance_id")
    known = names.select(F.upper(F.trim("name")).alias("__n")).distinct()
    items = items.join(known, F.upper(F.trim("label")) == known["__n"], "left")
    by_med = items.groupBy("medicine_id").agg(F.max(F.col("source").isNotNull()).alias("has_source"), F.max(F.col("__n").isNotNull()).alias("has_name"))
    m = market.join(by_med, market["medicine_ref"] == by_med["medicine_id"], "left")
    tags = F.array(F.when(F.col("has_doc"), F.lit("doc")), F.when(F.col("has_source"), F.lit("substance")), F.when(F.col("has_name"), F.lit("known")))
    return m.select("market_id", F.array_sort(F.array_compact(tags)).alias("tags"))
