"""Predicates and search filters as Columns; all are pushed down or folded by Catalyst."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def non_blank(c: str | Column) -> Column:
    """There, not null, not empty."""
    return _col(c).isNotNull() & (_col(c) != "")


def matches(c: str | Column, pattern: str, literal: bool = True) -> Column:
    """Case-insensitive containment, or a regular expression; false for null."""
    return _false(F.lower(_col(c)).contains(pattern.lower()) if literal else _col(c).rlike(f"(?i){pattern}"))


def match_any(columns: list[str], pattern: str, literal: bool = True) -> Column:
    return reduce(or_, [matches(c, pattern, literal) for c in columns])


def match_array(c: str | Column, pattern: str, literal: bool = True) -> Column:
    """Any element matches."""
    return _false(F.exists(_col(c), lambda x: matches(x, pattern, literal)))


def equals_ci(c: str | Column, value: str) -> Column:
    return _false(F.lower(_col(c)) == value.lower())


def has_any(c: str | Column, values: list) -> Column:
    return _false(F.arrays_overlap(_col(c), F.array(*[F.lit(v) for v in values])))


def nested_texts(sections: str | Column) -> Column:
    """All texts of the subsections of sections: array<struct<subsections: array<struct<content: array<struct<text>>>>>>."""
    empty = F.array()
    subs = F.flatten(F.transform(_col(sections), lambda s: F.coalesce(s["subsections"], empty.cast("array<struct<title:string,content:array<struct<text:string>>>>"))))
    return F.flatten(F.transform(subs, lambda s: F.transform(F.coalesce(s["content"], empty.cast("array<struct<text:string>>")), lambda c: c["text"])))


def nested_text_filter(sections: str | Column, pattern: str, negate: bool = False) -> Column:
    """Some text below matches, or with ``negate`` none does; a missing path has no match, so it meets the negation."""
    found = match_array(nested_texts(sections), pattern)
    return ~found if negate else found


def match_paths(paths: list[Column], pattern: str) -> Column:
    """The pattern is found in any of several texts or arrays of texts (given as arrays)."""
    return reduce(or_, [match_array(p, pattern) for p in paths])


def any_elem(c: str | Column, test) -> Column:
    return _false(F.exists(_col(c), test))


def first_elem(c: str | Column, test) -> Column:
    return F.get(F.filter(_col(c), test), F.lit(0))


def pending(error: str | Column, done: str | Column, retry: str | Column, prefixes: tuple[str, ...]) -> Column:
    """Never processed, or failed in a way worth another try."""
    again = reduce(or_, [_false(F.startswith(_col(error), F.lit(p))) for p in prefixes])
    return _col(done).isNull() | again | _false(_col(retry))


def visible_rows(status: str | Column, visibility: str | Column, role: object) -> Column:
    return _false((_col(status) == "published") & F.array_contains(_col(visibility), F.lit(role)))


def shape_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows where an array column is missing, empty, or has a first element that is (not) a number."""
    c = F.col(column)
    first = F.get(c, F.lit(0))
    number = F.try_to_number(first, F.lit("999999999999")).isNotNull()
    return df.agg(F.count_if(c.isNull()).alias("missing"), F.count_if(F.size(c) == 0).alias("empty"), F.count_if(first.isNotNull()).alias("some"), F.count_if(first.isNotNull() & ~number).alias("wrong_type"))


@dataclass
class SearchSpec:
    """Optional filters; each one that is given adds a term, none gives all rows."""

    text: str | None = None
    text_columns: list[str] = field(default_factory=list)
    literal: bool = True
    equal: dict[str, str | None] = field(default_factory=dict)
    contains: dict[str, str | None] = field(default_factory=dict)
    flags: dict[str, bool | None] = field(default_factory=dict)
    any_of: dict[str, list | None] = field(default_factory=dict)

    def terms(self) -> list[Column]:
        out = [match_any(self.text_columns, self.text, self.literal)] if self.text and self.text_columns else []
        out += [equals_ci(c, v) for c, v in self.equal.items() if v]
        out += [matches(c, v) for c, v in self.contains.items() if v]
        out += [_false(F.col(c) == v) for c, v in self.flags.items() if v is not None]
        return out + [has_any(c, v) for c, v in self.any_of.items() if v]

    def apply(self, df: DataFrame) -> DataFrame:
        terms = self.terms()
        return df.where(reduce(and_, terms)) if terms else df


def literal_pattern(text: str) -> str:
    return re.escape(text)
