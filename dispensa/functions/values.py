"""Dates, arrays, JSON and numbers as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_date(c: Column, missing: str = "-") -> Column:
    """yyyy-MM-dd of seconds since the epoch (session time zone UTC)."""
    return F.coalesce(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd"), F.lit(missing))


def ymd_int(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{8}$"), c.cast("int"))


def is_fresh(ts: Column, now: Column, ttl: int = 600) -> Column:
    """Whether ts (seconds) is less than ttl before now."""
    return F.coalesce(now - ts < ttl, F.lit(False))


def slice_n(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def first_where(c: Column, test) -> Column:
    return F.get(F.filter(c, test), F.lit(0))


def safe_get(c: Column, path: str, default: object) -> Column:
    return F.coalesce(F.get_json_object(c, f"$.{path}"), F.lit(default))


def variant_get(v: Column, path: str, kind: str, default: object) -> Column:
    """A member of a parsed document as the type that is asked for; the default where it is missing, null, or of a type that does not become it."""
    return F.coalesce(F.try_variant_get(v, f"$.{path}", kind), F.lit(default))


def clamp(c: Column, low: object, high: object) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def walk_sections(df: DataFrame, key: str, json: str, name: str = "Section", depth: int = 4) -> DataFrame:
    """(key, level, path, heading): every element of each nested ``Section`` list, to a given depth."""
    level = df.select(key, F.parse_json(json).alias("v"), F.lit("").alias("path"))
    out = None
    for k in range(1, depth + 1):
        lists = level.select(key, "path", F.expr(f"try_variant_get(v, '$.{name}', 'array<variant>')").alias("list"))
        level = lists.select(key, "path", F.posexplode("list").alias("i", "v")).withColumn("path", F.concat("path", F.lit("/"), "i"))
        rows = level.select(key, F.lit(k).alias("level"), "path", F.expr("try_variant_get(v, '$.TOCHeading', 'string')").alias("heading"))
        out = rows if out is None else out.union(rows)
    return out
