"""Regulatory documents: lines to sections, markup to rows, search and prompt texts, crawl changes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from .windows import between_markers, carry_forward


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _joined(rows: DataFrame, key: str, code: str, line: str) -> DataFrame:
    """(key, code, text): lines in order."""
    return rows.groupBy(key, code).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def split_numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, text): a line like ``4.2. TITLE`` opens a section that runs to the next; of sections with one number the last wins."""
    code = F.nullif(F.regexp_extract("line", r"^\s*([0-9]+(?:\.[0-9]+)+)\.?\s+\S", 1), F.lit(""))
    rows = carry_forward(lines_of(docs, key, text).withColumn("code", code), key, "pos", F.when(F.col("code").isNotNull(), F.struct("code", "pos")), "open").where("open is not null")
    newest = rows.withColumn("last", F.max("open.pos").over(Window.partitionBy(key, F.col("open.code")))).where("open.pos = last")
    return _joined(newest.select(key, F.col("open.code").alias("code"), "pos", "line"), key, "code", "line")


# The outline of a product summary.
MAINS, SUBS = range(1, 11), {4: 9, 5: 3, 6: 6}


def split_outline(docs: DataFrame, key: str, text: str, start: str = "RÉSUMÉ DES CARACTÉRISTIQUES DU PRODUIT", end: str = "^ANNEXE ") -> DataFrame:
    """(key, code, text) of the sections of the outline only.

    A bare number takes the next line as its title unless that is a header; a sub-number outside
    the outline is left out and changes nothing; a main number outside it is content.
    """
    lines = lines_of(docs, key, text).withColumn("line", F.trim("line"))
    inside = between_markers(lines, key, "pos", "line", F.upper("line").contains(start), F.col("line").rlike(end)).where("line <> ''")
    main = F.regexp_extract("line", r"^([0-9]{1,2})\.?(?:([0-9])\.?)?(?:\s+|$)", 1)
    sub = F.regexp_extract("line", r"^([0-9]{1,2})\.([0-9])\.?(?:\s+|$)", 2)
    dotted = F.col("line").rlike(r"^[0-9]{1,2}\.")
    rows = inside.withColumns({"main": F.when(dotted, F.try_to_number(F.nullif(main, F.lit("")), F.lit("99")).cast("int")), "sub": F.when(dotted, F.try_to_number(F.nullif(sub, F.lit("")), F.lit("9")).cast("int"))})
    good_sub = F.lit(False)
    for m, n in SUBS.items():
        good_sub = good_sub | ((F.col("main") == m) & F.col("sub").between(1, n))
    is_sub = F.col("sub").isNotNull()
    rows = rows.withColumn("code", F.when(is_sub & good_sub, F.concat_ws(".", "main", "sub")).when(~is_sub & F.col("main").between(MAINS[0], MAINS[-1]), F.col("main").cast("string")))
    rows = rows.where(F.col("code").isNotNull() | ~F.coalesce(is_sub, F.lit(False)))
    w = Window.partitionBy(key).orderBy("pos")
    bare = F.col("line").rlike(r"^[0-9]{1,2}\.([0-9]\.?)?$") & F.col("code").isNotNull()
    rows = rows.withColumns({"bare": bare, "next": F.lead("line").over(w), "next_code": F.lead("code").over(w), "taken": F.lag(bare).over(w)})
    rows = rows.where(~(F.coalesce("taken", F.lit(False)) & F.col("code").isNull()))
    rows = rows.withColumn("line", F.when(F.col("bare") & F.col("next_code").isNull() & F.col("next").isNotNull(), F.concat_ws(" ", "line", "next")).otherwise(F.col("line")))
    rows = carry_forward(rows, key, "pos", F.when(F.col("code").isNotNull(), F.struct("code", "pos")), "open").where("open is not null")
    newest = rows.withColumn("last", F.max("open.pos").over(Window.partitionBy(key, F.col("open.code")))).where("open.pos = last")
    return _joined(newest.select(key, F.col("open.code").alias("code"), "pos", "line"), key, "code", "line")


def section_tree(sections: DataFrame, key: str) -> DataFrame:
    """(key, code, parent, title): the parent is the code without its last part, if there is such a section; else the section is a root."""
    parent = F.when(F.col("code").contains("."), F.regexp_replace("code", r"\.[^.]+$", ""))
    rows = sections.select(key, "code", parent.alias("parent"), F.split("text", "\n")[0].alias("title"))
    there = sections.select(key, F.col("code").alias("parent"), F.lit(True).alias("found"))
    return rows.join(there, [key, "parent"], "left").select(key, "code", F.when(F.col("found"), F.col("parent")).alias("parent"), "title")


class _Rows(HTMLParser):
    """Text of the block elements of a page, in order."""

    LEVEL = {**{f"h{k}": k for k in range(1, 7)}, "p": 9, "li": 9, "td": 9, "th": 9}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.LEVEL:
            self.close_block()
            self.open = tag

    def handle_endtag(self, tag):
        if tag == self.open:
            self.close_block()

    def handle_data(self, data):
        if self.open:
            self.text.append(data)

    def close_block(self):
        if self.open:
            self.rows.append((self.LEVEL[self.open], self.open, " ".join("".join(self.text).split())))
        self.open, self.text = None, []


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, level, tag, text): headings, paragraphs, list items and cells of each page. A parser is what expressions cannot replace."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[key], batch[html], strict=True):
                parser = _Rows()
                parser.feed(text or "")
                parser.close_block()
                out += [(page, i, *row) for i, row in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=[key, "pos", "level", "tag", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, level int, tag string, text string")


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """html_rows with the heading that each row stands under, or 'unsectioned'."""
    rows = html_rows(pages, key, html)
    return carry_forward(rows, key, "pos", F.when(F.col("tag").startswith("h"), F.col("text")), "heading").withColumn("heading", F.coalesce("heading", F.lit("unsectioned")))


# Anchors and classes of regulatory pages.
STARTS, ENDS, DATED = "RcpDenomination", "RcpInstPrepRadioph", "DateNotif"
HOLDER, FORM = "RcpTitulaireAmm", "RcpFormePharm"
HEADING, BOLD, NAMED, BULLETS = "AmmAnnexeTitre", "AmmCorpsTexteGras", "AmmDenomination", "AmmListePuces"
ROW = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("underline", pa.bool_()), ("list_type", pa.string()), ("alignment", pa.string()), ("headers", pa.list_(pa.string())), ("cells", pa.list_(pa.list_(pa.string()))), ("caption", pa.string())])


# Elements whose content is no markup; tags, what is left of which is plain if it is attributes only.
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext")
_NAME, _SPACE = r"[a-zA-Z][a-zA-Z0-9_:.-]*", r"[ \t\n\r\f]"
_VALUE = rf"""(?:"[^"]*"|'[^']*'|[^ \t\n\r\f"'=`/&]+(?={_SPACE}|$))"""
TAG = re.compile(rf"<(/?{_NAME})([^<>]*)>")
ATTRIBUTE = re.compile(rf"({_NAME})(?:=({_VALUE}))?")
ATTRIBUTES = re.compile(rf"(?:{_SPACE}+{_NAME}(?:={_VALUE})?)*{_SPACE}*/?")


class _Marks(NamedTuple):
    """What counts of a tag's attributes."""

    name: str
    dated: bool
    level: int | None
    bold: bool
    italic: bool
    underline: bool
    bullets: bool
    alignment: str


@lru_cache(1 << 12)
def _marks(name: str, marks: str, style: str) -> _Marks:
    level, style = marks.partition(HEADING)[2][:1], style.lower().replace(" ", "")
    return _Marks(name, DATED in marks.split(), int(level) if level.isdigit() else None, "gras" in marks or BOLD in marks, "italique" in marks, "souligne" in marks, BULLETS in marks, "center" if "center" in marks or "text-align:center" in style else "left")


@lru_cache(1 << 12)
def _marks_in(tag: str) -> _Marks | None:
    """The marks of what follows a tag's name; None if that is not plain."""
    if not ATTRIBUTES.fullmatch(tag):
        return None
    a = {k.lower(): unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in ATTRIBUTE.findall(tag)}
    return _marks(a.get("name", ""), a.get("class", ""), a.get("style", ""))


@lru_cache(1 << 12)
def _plain_name(tag: str) -> str | None:
    """A tag's name in lower case; None for one whose content is no markup."""
    return None if tag.lower() in RAW else tag.lower()


class _Parser(HTMLParser):
    """Tells a reader the tags and texts of markup that is not plain."""

    def __init__(self, to: _Regulatory):
        super().__init__(convert_charrefs=True)
        self.to = to

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.to.start(tag, _marks(a.get("name", ""), a.get("class", ""), a.get("style", "")))

    def handle_endtag(self, tag):
        self.to.stop(tag)

    def handle_data(self, data):
        self.to.say(data)


class _Regulatory:
    """Headings, texts and tables between a page's start and end anchors, in order; each text once, with its innermost block. Each has the heading it belongs to."""

    def __init__(self):
        self.rows, self.table, self.lists, self.heads = [], None, [], []
        self.on, self.last, self.depth, self.cell = False, False, 0, None
        self.block = None  # its marks; said, bold, italic, listed and anchor are the open block's too

    def read(self, text: str) -> list[tuple]:
        """Rows as tuples of ROW's fields. Plain markup, which is most, is split into its tags at once; the rest is parsed, which takes several times as long."""
        parts = TAG.split(text)
        if "<" in "".join(parts[::3]):
            return self.parse(text)
        for said, tag, rest in zip(parts[::3], parts[1::3], parts[2::3], strict=False):
            if said and (self.cell or self.block):
                self.say(unescape(said) if "&" in said else said)
            tag, marks = _plain_name(tag), _marks_in(rest)
            if tag is None or marks is None or tag[0] == "/" and rest and not rest.isspace():
                return type(self)().parse(text)
            if tag[0] == "/":
                self.stop(tag[1:])
            else:
                self.start(tag, marks)
                if rest[-1:] == "/":
                    self.stop(tag)
        self.say(unescape(parts[-1]))
        return self.end()

    def parse(self, text: str) -> list[tuple]:
        parser = _Parser(self)
        parser.feed(text)
        parser.close()
        return self.end()

    def end(self) -> list[tuple]:
        if self.table is not None:
            self.close_table()
        self.close_block()
        return self.rows

    def start(self, tag: str, marks: _Marks) -> None:
        if tag == "a" and marks.name == STARTS or tag == "p" and marks.dated and not self.on:
            self.close_block(keep=False)
            self.on = True
        elif tag == "a" and marks.name == ENDS and self.on:
            self.last = True  # the block that holds the end is the last
            if not self.block:
                self.on = False
        elif self.on and not self.last:
            self._inside(tag, marks)

    def _inside(self, tag: str, marks: _Marks) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.close_block()
                self.table = {"headers": [], "cells": [], "caption": None, "head": False}
        elif self.table is not None:
            if self.depth == 1:
                if tag == "tr":
                    self.table["cells"].append([])
                elif tag in ("td", "th", "caption"):
                    self.close_cell()
                    self.cell = (tag, [])
                elif tag == "thead":
                    self.table["head"] = True
        elif tag in ("p", "div", "li"):
            self.close_block()
            self.block, self.said, self.anchor = marks, [], None
            self.bold, self.italic = marks.bold, marks.italic
            self.listed = "bullet" if marks.bullets else self.lists[-1] if self.lists else None
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append("bullet" if tag == "ul" else "numbered")
        elif self.block:
            self.bold |= tag in ("b", "strong")
            self.italic |= tag in ("i", "em")
            if tag == "a" and self.anchor is None:
                self.anchor = [len(self.said), None]

    def stop(self, tag: str) -> None:
        if self.table is not None:
            if tag == "table":
                self.depth -= 1
                if not self.depth:
                    self.close_table()
            elif self.depth == 1 and tag in ("td", "th", "caption", "tr"):
                self.close_cell()
            elif self.depth == 1 and tag == "thead":
                self.close_cell()
                self.table["head"] = False
        elif tag in ("p", "div", "li"):
            self.close_block()
        elif tag in ("ul", "ol") and self.lists:
            self.close_block()
            self.lists.pop()
        elif tag == "a" and self.block and self.anchor and self.anchor[1] is None:
            self.anchor[1] = len(self.said)

    def say(self, data: str) -> None:
        if self.cell:
            self.cell[1].append(data)
        elif self.block:
            self.said.append(data)

    def close_cell(self) -> None:
        if self.cell:
            tag, text = self.cell[0], " ".join("".join(self.cell[1]).split())
            if tag == "caption":
                self.table["caption"] = text
            else:
                self.table["cells"] = self.table["cells"] or [[]]
                self.table["cells"][-1].append(text)
                if tag == "th" and self.table["head"]:
                    self.table["headers"].append(text)
        self.cell = None

    def close_table(self) -> None:
        self.close_cell()
        t = self.table
        self.rows.append(("table", None, None, None, None, None, None, None, t["headers"], [r for r in t["cells"] if any(r)], t["caption"], *self._above()))
        self.table, self.depth = None, 0

    def _above(self) -> tuple[int | None, str]:
        """The place and text of the heading that content stands under."""
        return self.heads[-1][1:] if self.heads else (None, "unsectioned")

    def close_block(self, keep: bool = True) -> None:
        if self.block and keep:
            text = " ".join("".join(self.said).split())
            level = self.block.level
            if level is not None and self.anchor:
                text = " ".join("".join(self.said[self.anchor[0] : self.anchor[1]]).split()) or text
            if text:
                own = (text, self.bold, self.italic, self.block.underline, self.listed, self.block.alignment, None, None, None)
                if level is None:
                    self.rows.append(("text", None, *own, *self._above()))
                else:
                    while self.heads and self.heads[-1][0] >= level:
                        self.heads.pop()
                    self.rows.append(("heading", level, *own, *(self._above() if self.heads else (None, None))))
                    self.heads.append((level, len(self.rows) - 1, text))
        self.block = None
        if self.last:
            self.on = False


PAGES = 256  # pages whose rows a task holds at once


def regulatory_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """regulatory_rows with ``section``, the (pos, text) that a row belongs to: for content the heading before it, for a heading the nearest one before it of a lower level.

    Content before all headings is in a section 'unsectioned' without a place; a heading without a parent has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES):
                some = batch.slice(first, PAGES)
                at, pos, rows = [], [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    found = _Regulatory().read(text or "")
                    at += [i] * len(found)
                    pos += range(len(found))
                    rows += found
                said = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), [*[f.type for f in ROW], pa.int32(), pa.string()], strict=True)] if rows else []
                if said:
                    place, head = said[-2:]
                    section = pa.StructArray.from_arrays([place, head], ["pos", "text"], mask=pc.is_null(head))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *said[:-2], section], names=[key, "pos", *[f.name for f in ROW], "section"])

    kind = pages.schema[key].dataType.simpleString()
    flags = "kind string, level int, text string, bold boolean, italic boolean, underline boolean, list_type string, alignment string, headers array<string>, cells array<array<string>>, caption string"
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, pos int, {flags}, section struct<pos:int,text:string>")


def regulatory_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, level, text, bold, italic, underline, list_type, alignment, headers, cells, caption) of each page from its start anchor to its end anchor.

    A page without a start gives none; blank texts give none; a block that is open at the start, as the heading
    that holds the start anchor, gives none.
    """
    return regulatory_sections(pages, key, html).drop("section")


def html_metadata(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, holder, form) of a page, each null if not found.

    Title: the named paragraph after the start anchor; else a heading of the class ``textedeno`` up to its dash; else a
    named paragraph of more than 5 characters; for other pages the title element, else the first heading.
    Holder: of the five blocks after its anchor the first bold span that is no postcode, else the first bold block that
    is no heading, else the first block that is no heading or address; for other pages a labelled text, the author or the footer.
    Form: the paragraph after its anchor, else the title after its first comma.
    """
    clean = lambda c: F.nullif(F.trim(strip_tags(c)), F.lit(""))
    pick = lambda p: clean(F.regexp_extract(html, p, 1))
    after = lambda name: F.regexp_extract(html, rf'(?is)<a[^>]*\bname="{name}"(.*)', 1)
    named = rf'(?is)<p[^>]*class="[^"]*(?:{BOLD}|{NAMED})[^>]*>(.*?)</p>'
    deno = pick(r'(?is)<h1[^>]*class="[^"]*\btextedeno\b[^>]*>(.*?)</h1>')
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(named), F.lit(1)), lambda x: F.trim(strip_tags(x)))
    title = F.coalesce(
        clean(F.regexp_extract(after(STARTS), named, 1)),
        F.trim(F.split(deno, " - ")[0]),
        F.get(F.filter(paragraphs, lambda x: F.length(x) > 5), F.lit(0)),
        pick(r"(?is)<title[^>]*>(.*?)</title>"),
        pick(r"(?is)<h1[^>]*>(.*?)</h1>"),
        pick(r"(?is)<h2[^>]*>(.*?)</h2>"),
    )
    blocks = F.slice(F.regexp_extract_all(after(HOLDER), F.lit(r"(?is)(<(p|div)\b[^>]*>.*?</\2>)"), F.lit(1)), 1, 5)
    solid = lambda texts, *tests: F.get(F.filter(texts, lambda x: (x != "") & ~x.rlike("|".join(tests))), F.lit(0))
    texts = lambda marked: F.transform(marked, lambda x: F.trim(strip_tags(x)))
    spans = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'(?is)<span[^>]*class="[^"]*\bgras\b[^>]*>(.*?)</span>'), F.lit(1))))
    bold = F.filter(blocks, lambda b: b.rlike(rf'(?is)^<p[^>]*class="[^"]*{BOLD}|<span[^>]*class="[^"]*\bgras\b'))
    heads, postcode = r"^(7\.|8\.|TITULAIRE|DATE)", r"^[0-9]{5}"
    holder = F.coalesce(
        solid(texts(spans), postcode, r"[0-9]{5}\s"),
        solid(texts(bold), heads, postcode),
        solid(texts(blocks), heads, r"\b[0-9]{5}\b", "(?i)rue|avenue|boulevard|cedex"),
        pick(r"(?is)Titulaire[^:]*:\s*([^<]+)<"),
        pick(r'(?is)name="author" content="([^"]*)"'),
        pick(r"(?is)<footer[^>]*>(.*?)</footer>"),
    )
    form = F.regexp_replace(clean(F.regexp_extract(after(FORM), r"(?is)<p\b[^>]*>(.*?)</p>", 1)), r"\.+$", "")
    return pages.select(key, title.alias("title"), holder.alias("holder"), F.coalesce(form, F.nullif(F.trim(F.regexp_extract(title, r"(?s)^[^,]*,(.*)$", 1)), F.lit(""))).alias("form"))


def html_links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, links): distinct absolute addresses of a page's links, sorted."""
    host = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)
    found = F.filter(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]+)'), F.lit(1)), lambda x: x != "")
    full = F.transform(found, lambda x: F.when(x.rlike("^[a-z]+:"), x).when(F.startswith(x, F.lit("/")), F.concat(host, x)).otherwise(F.concat(host, F.lit("/"), x)))
    return pages.select(key, F.array_sort(F.array_distinct(full)).alias("links"))


def document_links(pages: DataFrame, key: str, html: str, url: str, panel: str, words: tuple[str, ...], host: str | None = None) -> DataFrame:
    """(key, links): distinct absolute addresses of a page's documents, sorted.

    In the panel with the id ``panel`` (up to the next panel) these are links whose text holds one of ``words``, PDF files
    and addresses that hold ``host``; without any there, the PDF files and addresses that hold ``host`` of the whole page.
    """
    site = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*/)", 1)
    folder = F.concat(site, F.when(path == "", F.lit("/")).otherwise(path))
    link = r'(?is)(<a\b[^>]*\bhref="[^"]+"[^>]*>.*?</a>)'

    def found(part: Column, named: bool) -> Column:
        whole = F.transform(F.regexp_extract_all(part, F.lit(link), F.lit(1)), lambda x: F.struct(F.trim(F.regexp_extract(x, r'(?is)^<a\b[^>]*\bhref="([^"]+)"', 1)).alias("to"), F.lower(strip_tags(x)).alias("said")))
        at = F.transform(F.filter(whole, lambda x: x["to"] != ""), lambda x: F.struct(F.when(x["to"].rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), x["to"]).when(x["to"].startswith("/"), F.concat(site, x["to"])).otherwise(F.concat(folder, x["to"])).alias("to"), x["said"].alias("said")))

        def good(x: Column) -> Column:
            test = F.endswith(F.lower(x["to"]), F.lit(".pdf"))
            if host:
                test = test | F.contains(x["to"], F.lit(host))
            for word in words if named else ():
                test = test | F.contains(x["said"], F.lit(word))
            return test

        return F.array_sort(F.array_distinct(F.transform(F.filter(at, good), lambda x: x["to"])))

    stem = panel.split("-")[0]
    inside = found(F.regexp_extract(html, rf'(?is)\bid="{panel}"(.*?)(?:\bid="{stem}-|$)', 1), True)
    return pages.select(key, F.when(F.size(inside) > 0, inside).otherwise(found(F.col(html), False)).alias("links"))


def html_monograph(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, rubric, row, cells): table rows of each element with an id, cells as texts."""
    # A block runs from its id to the next one, so that no block takes another's table and each page is read once.
    blocks = F.slice(F.split(html, r'(?i)<(?:div|section|article|p|h[1-6])\b[^>]*\bid="'), 2, 1 << 30)
    b = pages.select(key, F.explode(blocks).alias("b")).select(key, F.substring_index("b", '"', 1).alias("rubric"), F.regexp_extract("b", r"(?is)(<table\b.*?</table>)", 1).alias("b"))
    r = b.select(key, "rubric", F.posexplode(F.regexp_extract_all("b", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    return r.select(key, "rubric", "row", F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags).alias("cells"))


CELL = pa.struct([("text", pa.string()), ("bold", pa.string()), ("items", pa.list_(pa.string())), ("listed", pa.list_(pa.string()))])
TABLE_ROWS = [("pos", pa.int32()), ("row", pa.int32()), ("classes", pa.list_(pa.string())), ("marked", pa.bool_()), ("note", pa.string()), ("whole", pa.string()), ("cells", pa.list_(CELL))]


class _Text:
    """An element whose text is gathered while it is open, with the parts of it that are told apart."""

    def __init__(self, tag: str):
        self.tag, self.words, self.parts = tag, [], []

    def text(self) -> str:
        return " ".join(" ".join(self.words).split())

    def of(self, tag: str) -> list[str]:
        return [p.text() for p in self.parts if p.tag == tag]


class _Tables(HTMLParser):
    """The rows of all tables of a page. What is inside a nested table is inside the tables around it, too: its rows are theirs, and its cells those of their row."""

    def __init__(self, marker: str):
        super().__init__(convert_charrefs=True)
        self.marker, self.marked, self.tables, self.open = marker, False, [], []

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        if tag == "table":
            table = {"pos": len(self.tables), "classes": names, "marked": self.marked, "whole": _Text("table"), "rows": [], "note": None}
            self.tables.append(table)
            self.open.append((tag, table["whole"], table))
            return
        if tag in ("tr", "td", "th"):  # ends those of the innermost table that are open
            self.shut(("td", "th") if tag != "tr" else ("tr", "td", "th"))
        if tag not in ("tr", "td", "th", "b", "li", "ul", "div"):
            return
        own = _Text(tag)
        tables = [t for _, _, t in self.open if t is not None]
        if tag == "tr":
            for t in tables:
                t["rows"].append((own, []))
        elif tag == "td":
            rows = [e for name, e, _ in self.open if name == "tr"]
            for t in tables:
                for row, cells in t["rows"]:
                    if any(row is r for r in rows):
                        cells.append(own)
        elif tag == "div" and "text" in names:
            for t in tables:
                t["note"] = t["note"] or own
        for _, e, _ in self.open:
            e.parts.append(own)
        self.open.append((tag, own, None))

    def shut(self, tags) -> None:
        """Close the innermost table's open elements down from the outermost of these tags."""
        base = max((k for k, x in enumerate(self.open) if x[0] == "table"), default=-1)
        first = next((k for k in range(base + 1, len(self.open)) if self.open[k][0] in tags), None)
        if first is not None:
            del self.open[first:]

    def handle_endtag(self, tag):
        if tag == "table":
            at = max((k for k, x in enumerate(self.open) if x[0] == "table"), default=None)
        else:
            base = max((k for k, x in enumerate(self.open) if x[0] == "table"), default=-1)
            at = max((k for k in range(base + 1, len(self.open)) if self.open[k][0] == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.marked |= bool(self.marker) and self.marker in data
        for _, e, _ in self.open:
            e.words.append(data)

    def found(self) -> list[dict]:
        def cell(e: _Text) -> dict:
            items = [x for x in e.of("li") if x] if e.of("li") else [x for x in [e.text()] if x]
            lists = [p for p in e.parts if p.tag == "ul"]
            return {"text": e.text(), "bold": next(iter(e.of("b")), None), "items": items, "listed": [x for x in lists[0].of("li") if x] if lists else []}

        return [{"pos": t["pos"], "row": k, "classes": t["classes"], "marked": t["marked"], "note": t["note"].text() if t["note"] else None, "whole": t["whole"].text(), "cells": [cell(c) for c in cells]} for t in self.tables for k, (_, cells) in enumerate(t["rows"] or [(None, [])])]


def table_rows(pages: DataFrame, key: str, html: str, marker: str = "") -> DataFrame:
    """(key, pos, row, classes, marked, note, whole, cells): the rows of each table of a page, tables numbered in order, nested ones too.

    A cell has its text, its first bold text (null without one), its list items (its own text without a list) and the items of its first list. marked: whether the
    text ``marker`` is anywhere before the table; note: the text of the table's first block of class ``text``; whole: all of its text. Rows and cells of
    nested tables are also those of the tables around them. A table without rows has one without cells. Null and empty pages give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for page, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parser = _Tables(marker)
                parser.feed(text or "")
                parser.close()
                rows = parser.found()
                out += rows
                keys += [page.as_py()] * len(rows)
            columns = [pa.array([r[name] for r in out], kind) for name, kind in TABLE_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *columns], names=[key, *(name for name, _ in TABLE_ROWS)])

    kind = pages.schema[key].dataType.simpleString()
    cells = "array<struct<text:string,bold:string,items:array<string>,listed:array<string>>>"
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, pos int, row int, classes array<string>, marked boolean, note string, whole string, cells {cells}")


# The marks of a contraindication page, in its markup's language.
MONO, COMMENTS = "table_mono", "Commentaires du RCP"
TERRAIN = r"(?i)Terrain\s*N[°o]\s*(\d+)"
LEVEL, REFERENCE, CODES, UNCONCERNED = "niveau", "référence|reference", "cim", "non concern"
CODE = r"\b([A-Z][0-9]{2,3}[0-9A-Z]?)\b"


def _mono(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, marked, note, whole, rows): the cells of each row of the tables of the monograph's class, in order; a page's markup bounds them."""
    rows = table_rows(pages, key, html, COMMENTS).where(F.array_contains("classes", MONO))
    one = rows.groupBy(key, "pos").agg(F.first("marked").alias("marked"), F.first("note").alias("note"), F.first("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    return one.withColumn("rows", F.transform("rows", lambda r: r["cells"]))


def contraindications(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, no, heading, details, level, references, codes): one row per table of a page whose first cell has a terrain's number.

    Heading: the first bold text of the second cell, else all of it; details: the items of its first list. Further rows
    are told by their first cell, the last of a kind counts. A code is the last one in an item, else the item; items that
    say that nothing is concerned give none; each code stays once, in order. Rows of nested tables count as the table's; ``pos``
    counts all tables of the page. Null and empty pages give no rows; lists that are not there are empty.
    """
    split = _mono(pages, key, html).select(key, "pos", F.get("rows", F.lit(0)).alias("first"), F.filter(F.slice("rows", 2, 1 << 30), lambda r: F.size(r) > 1).alias("more"))
    known = split.withColumn("no", F.regexp_extract(F.get("first", F.lit(0))["text"], TERRAIN, 1)).where("no <> ''")
    right = F.get("first", F.lit(1))
    none = F.array().cast("array<string>")
    label = lambda r: F.lower(r[0]["text"])

    def told(test, without=()) -> Column:
        """Items of the last row whose label has the mark, and no earlier one."""
        own = F.filter("more", lambda r: label(r).rlike(test) & ~(label(r).rlike("|".join(without)) if without else F.lit(False)))
        return F.when(F.size(own) > 0, F.element_at(own, -1)[1]["items"]).otherwise(none)

    code = lambda x: F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(x, F.lit(CODE), F.lit(1))), -1), x)
    return known.select(
        key,
        "pos",
        F.col("no").cast("long").alias("no"),
        F.coalesce(right["bold"], right["text"], F.lit("")).alias("heading"),
        F.coalesce(right["listed"], none).alias("details"),
        told(LEVEL).alias("level"),
        told(REFERENCE, (LEVEL,)).alias("references"),
        F.array_distinct(F.transform(F.filter(told(CODES, (LEVEL, REFERENCE)), lambda x: ~F.lower(x).contains(UNCONCERNED)), code)).alias("codes"),
    )


def contraindication_notes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, comments, reference) of every page: the text of the first table of the monograph's class after the words that announce the comments, and its official reference.

    The text is that of the table's block of class ``text``, else all of it. The reference is the first item beside the first label that names
    one; both are empty where there is none.
    """
    after = _mono(pages, key, html).where("marked").groupBy(key).agg(F.min_by(F.struct("note", "whole", "rows"), "pos").alias("t"))
    labelled = F.filter("t.rows", lambda r: (F.size(r) > 1) & F.lower(r[0]["text"]).contains("référence"))
    found = after.select(key, F.coalesce("t.note", "t.whole").alias("comments"), F.get(F.get(labelled, F.lit(0))[1]["items"], F.lit(0)).alias("reference"))
    return pages.select(key).join(found, key, "left").na.fill("", ["comments", "reference"])


def topic_text(sections: Column, main: str, sub: str, label: str) -> Column:
    """Text of a labelled part of a sub-section, else all of it; null without the sub-section."""
    level = lambda arr, code: F.get(F.filter(arr, lambda s: F.startswith(s["title"], F.lit(code))), F.lit(0))
    part = level(level(sections, main)["subsections"], sub)
    texts = F.transform(part["content"], lambda c: c["text"])
    own = F.filter(texts, lambda x: F.startswith(F.lower(x), F.lit(label.lower())))
    return F.array_join(F.when(F.size(own) > 0, own).otherwise(texts), "\n")


def index_text(*parts: Column) -> Column:
    """Texts and arrays of texts as one text for search."""
    return F.concat_ws(" ", *parts)


def context_text(texts: Column, each: int = 300, most: int = 5000, marker: str = "[...]") -> Column:
    """The first text that is not blank, cut to ``each``, of every hit (an array of arrays), together cut to ``most``."""
    first = F.transform(texts, lambda t: F.substring(F.get(F.filter(t, lambda x: F.trim(x) != ""), F.lit(0)), 1, each))
    whole = F.array_join(F.array_compact(first), "\n")
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit(marker))).otherwise(whole)


def crawl_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change): new, changed, same or gone, by content hash."""
    a, b = (df.select(key, F.md5(text).alias(n)) for df, n in ((old, "a"), (new, "b")))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("change"))


def purge_errors(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The column is null where it holds an error marker; ``purged`` says where."""
    bad = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.withColumn("purged", bad).withColumn(column, F.when(~F.col("purged"), F.col(column)))


def document_record(docs: DataFrame, key: str, text: str, title: str, sections: DataFrame) -> DataFrame:
    """One record per document: sections, title if there is one, search text, hash, status."""
    lists = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("code", F.length("text").alias("n")))).alias("sections"))
    status = F.when(F.col("sections").isNull(), "no section found").otherwise("ok")
    return docs.join(lists, key, "left").select(key, F.nullif(F.trim(F.col(title)), F.lit("")).alias("title"), "sections", F.lower(text).alias("search_text"), F.sha2(text, 256).alias("sha256"), status.alias("status"))
