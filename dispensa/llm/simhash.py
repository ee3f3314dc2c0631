"""SimHash near duplicates by multi-index hashing (operator 13).

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of a text's word
shingles. Only distinct fingerprints are compared. They are cut into segments; by the pigeonhole
principle two fingerprints at most MOST bits apart have, for one segment, values within a small
Hamming ball: with MOST = q * segments + a, radius q in the first a + 1 segments and q - 1 in the
others (none where that is negative). Every fingerprint is stored under its segment values and asks for all values of its balls;
a match is verified on all 64 bits inside the join, so that only links leave it.

A segment value that more than HOT fingerprints have is not compared pairwise. All who store or
ask for it give every value at most MOST / 2 bits from theirs: two fingerprints are at most MOST apart just when they
share such a midpoint, and a midpoint has at most as many fingerprints as there are values that near to it. So the
rows grow with the group, not with its square, and no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import LAST
from .components import components
from .jaccard import BROADCAST_IDS, _dealt
from .kernels import CHUNK, pieces, tidy
from .state import materialise

MOST = 4  # bits in which linked fingerprints may differ
WIDTH = 4  # words of a shingle
SEED = 42
HOT = 4096  # fingerprints of a segment value beyond which midpoints (2081 each) are the fewer rows


def shingle_hashes(text: str | None, width: int = WIDTH, size: int = CHUNK) -> Iterator[list[int]]:
    """The hashes of a text's shingles, repeats included, a piece of the text at a time; fewer words make one shingle."""
    h, kept, some = xxhash.xxh64_intdigest, [], False
    for piece in pieces((text or "").encode().lower(), size):  # bytes: only A-Z change
        words = kept + piece.split()  # at the six ASCII blanks
        n = len(words) - width + 1
        if n > 0:
            some = True
            line = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            first = np.concatenate([[0], end[:-1] + 1])[:n].tolist()
            yield [h(line[a:b], SEED) for a, b in zip(first, end[width - 1 :].tolist(), strict=True)]
        kept = words[-(width - 1) :] if width > 1 else []
    if kept and not some:
        yield [h(b" ".join(kept), SEED)]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text, width):
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; a null id becomes the last one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    own = docs.select(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def layout(n: int, most: int = MOST) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment for n fingerprints: about log2(n) bits each, so that a value is rare by chance."""
    count = min(most + 1, max(2, math.ceil(64 / math.log2(max(n, 2)))))
    radius, more = divmod(most, count)
    wide = [radius if k <= more else radius - 1 for k in range(count)]
    bits = [64 // count + (k < 64 % count) for k in range(count)]
    return [(sum(bits[:k]), bits[k], wide[k]) for k in range(count) if wide[k] >= 0]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` of them set."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _around(value: Column, masks: list[int]) -> Column:
    """The array of value with the bits of each mask flipped."""
    return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: value.bitwiseXOR(m))


def _keys(segments: list[tuple[int, int, int]], asking: bool) -> Column:
    """The keys (segment and value in one long) that a fingerprint is stored under, or asks for."""
    found = []
    for k, (low, bits, radius) in enumerate(segments):
        value = F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1).bitwiseOR(F.lit(k << 40))
        found.append(_around(value, ball(bits, radius)) if asking else F.array(value))
    return F.explode(F.concat(*found))


def links(classes: DataFrame, most: int = MOST, hot: int = HOT) -> DataFrame:
    """(x, y): ids of classes(fp, first) that are at most ``most`` bits apart; of hot segment values enough links to connect them alike."""
    if most % 2 or not 0 <= most <= 6:
        raise ValueError("midpoints are made for an even number of bits, 6 at most")
    segments = layout(classes.count(), most)
    stored = classes.select(_keys(segments, False).alias("key"), F.col("fp").alias("b"), F.col("first").alias("y"))
    asking = classes.select(_keys(segments, True).alias("key"), F.col("fp").alias("a"), F.col("first").alias("x"))
    many = materialise(stored.groupBy("key").count().where(F.col("count") > hot).select("key"))
    held = many.limit(BROADCAST_IDS + 1).count()
    if held:
        many = F.broadcast(many) if held <= BROADCAST_IDS else many
        crowd = asking.join(many, "key", "left_semi").select(F.col("a").alias("fp"), F.col("x").alias("first")).distinct()
        asking, stored = asking.join(many, "key", "left_anti"), stored.join(many, "key", "left_anti")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    near = asking.join(stored, (asking["key"] == stored["key"]) & (F.col("a") < F.col("b")) & apart).select("x", "y")
    if not held:
        return near
    middle = crowd.select(F.explode(_around(F.col("fp"), ball(64, most // 2))).alias("middle"), "first")
    groups = middle.groupBy("middle").agg(F.sort_array(F.collect_list("first")).alias("all")).where(F.size("all") > 1)
    return near.unionByName(groups.select(F.col("all")[0].alias("x"), F.explode(F.slice("all", 2, F.size("all") - 1)).alias("y")).distinct())


def simhash_groups(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", width: int = WIDTH, most: int = MOST, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, its own included).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; shingles of ``width`` words count as often as they occur, and a text with fewer
    words is one shingle. Texts without words, or null, have fingerprint zero and link like any other. Rows that share a doc_id are
    one node, linked by what any of them links; null ids are one node after all others and come back as null. Other columns
    are not read; an empty table gives none. No links are lost.
    """
    rows = materialise(fingerprints(docs, doc_id, text, width))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = links(classes, most, hot)
    # A doc_id whose rows have several fingerprints ties their classes together.
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).where("p <> q").select("doc_id")
    tied = materialise(rows.join(several, "doc_id", "left_semi").distinct())
    if tied.limit(1).count():
        found = found.unionByName(tied.join(classes, "fp").select(F.col("doc_id").alias("x"), F.col("first").alias("y")))
    label = components(found).withColumnsRenamed({"node": "first", "component": "least"})
    named = classes.join(label, "first", "left").select("fp", F.coalesce("least", "first").alias("least"))
    out = _dealt(rows, named, "fp", "doc_id")
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif("least", F.lit(LAST)).alias("component_id"))
