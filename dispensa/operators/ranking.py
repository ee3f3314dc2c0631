"""Pages, sort keys, typeahead and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, number: int = 1, per_page: int = 10, most: int = 100) -> DataFrame:
    """One page of an order that ends in a tie key; odd numbers are brought into range."""
    per_page = most if per_page > most else per_page if per_page >= 1 else 10
    return df.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page)


def latest_n(df: DataFrame, when: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(when), F.desc(tie)).limit(n)


def french_date_key(c: Column) -> Column:
    """yyyymmdd of dd/mm/yyyy; 0 for anything else."""
    part = lambda k: F.regexp_extract(c, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$", k)
    return F.coalesce(F.when(part(3) != "", part(3).cast("int") * 10000 + part(2).cast("int") * 100 + part(1).cast("int")), F.lit(0))


def sort_section_codes(c: Column) -> Column:
    """Dotted numbers in numeric order."""
    return F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.transform(F.split(x, r"\."), lambda p: p.cast("int")).alias("k"), x.alias("x")))), lambda s: s["x"])


def page_info(df: DataFrame, number: int, per_page: int) -> DataFrame:
    total = F.count("*")
    return df.agg(total.alias("total"), F.ceil(total / per_page).cast("long").alias("pages"), (total > number * per_page).alias("has_more"))


def typeahead(text: str, entities: DataFrame, brands: DataFrame, first: int = 15, then: int = 10, most: int = 20) -> DataFrame:
    """(kind, label): entity hits with an external id, then brand hits, each label once, at most ``most``; nothing for one letter."""
    if len(text) < 2:
        return entities.limit(0).select(F.lit("").alias("kind"), "label")
    hit = lambda df: df.where(F.contains(F.lower("label"), F.lit(text.lower())))
    one = hit(entities.where("external_id is not null")).select("label").distinct().orderBy("label").limit(first).select(F.lit(0).alias("rank"), F.lit("entity").alias("kind"), "label")
    two = hit(brands).select("label").distinct().orderBy("label").limit(then).select(F.lit(1).alias("rank"), F.lit("brand").alias("kind"), "label")
    w = Window.partitionBy(F.lower("label")).orderBy("rank", "label")
    return one.union(two).withColumn("__r", F.row_number().over(w)).where("__r = 1").orderBy("rank", "label").limit(most).select("kind", "label")


def cosine(a: Column, b: Column) -> Column:
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = double(a), double(b)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def vector_topk(df: DataFrame, key: str, vector: str, query: Column, k: int) -> DataFrame:
    """The k rows nearest to one vector by cosine, ties to the smaller key."""
    return df.select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
