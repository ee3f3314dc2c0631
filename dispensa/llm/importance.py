"""Importance resampling towards a target distribution, by hashed n-gram counts (operator 11).

The ``tokenizers`` library splits ASCII-lowered text by a regex, without any training, and returns
words with their offsets. Windows of one offset and of adjacent offset pairs are the features; the CRC of a window's bytes
chooses its bucket. Tasks add up bucket histograms of the corpus and of the target; the gain of a bucket is the
log of the ratio of its two smoothed shares. A document's weight is the mean gain of its features, and Gumbel
noise from its id makes the highest scores a draw without replacement in proportion to the weights' exponentials.
Ranks need no global sort: scores are integers of a bounded range, so a small table says how many rows lie above each.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import pieces, tidy
from .state import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # digits, small letters and all that is not ASCII
BREAK = np.zeros(256, bool)  # bytes that are in no word
BREAK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
BUCKETS = 10_000
PIECE = 1 << 15  # bytes of a text that are split at once
ROWS = 500  # documents of an output batch


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), "removed", invert=True)


def windows(text: str | None, split, most: int = 2, size: int = PIECE) -> tuple[int, list[int]]:
    """(words, the CRC of every run of 1 to ``most`` consecutive words joined by one space), a run for each place it is at."""
    from tokenizers import PreTokenizedString

    crc, words, found, before = zlib.crc32, 0, [], []
    for piece in pieces((text or "").encode().lower(), size, BREAK):  # bytes: only A-Z change
        whole = PreTokenizedString(piece.decode())
        split.pre_tokenize(whole)
        line, spans = [piece[a:b] for _, (a, b), _ in whole.get_splits("original", "byte")], before
        words += len(line)
        spans = before + line  # the last words of the piece before, whose windows go on here
        crcs = [crc(x) for x in spans]
        found += crcs[len(before) :]
        for k in range(1, most):
            # A window is one word longer than the last at the same place.
            crcs = [crc(x, crc(b" ", c)) for c, x in zip(crcs, spans[k:], strict=False)]
            found += crcs[max(0, len(before) - k) :]
        before = spans[-(most - 1) :] if most > 1 else []
    return words, found


def features(docs: DataFrame, doc_id: str | Column, text: str = "text", most: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets): the bucket of each feature of a row, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket number takes two bytes")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, packed = [], []
            for x in batch.column(1):
                n, crcs = windows(x.as_py(), split, most)
                counts.append(n)
                packed.append((np.array(crcs, np.uint32) % np.uint32(buckets)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "buckets"])

    return docs.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets binary")


def histogram(found: DataFrame) -> DataFrame:
    """(bucket, n) over all features; a task sends a row for each of its buckets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: how much likelier the target is to have it, add-one smoothed."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s_all + float(buckets)) / ((source.get(b, 0) + 1.0) * (t_all + float(buckets)))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths that the id alone decides; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of ``features``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            weight = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in own]
            score = [w + noise(d, seed) for w, d in zip(weight, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in ([len(b) for b in own], weight, score)]], ["doc_id", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """rows(doc_id, score, able, ...) with rank: 1 to ``drawn`` for the able rows by score descending, then doc_id with null last; else null.

    The only global order is over distinct scores, which are integers within the range that logs of 64-bit counts
    leave (about 200,000 values, so they are broadcast). Rows are ordered within a score, where noise puts a few in ten thousand at most.
    """
    order = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.where("able").groupBy("score").count().withColumn("above", F.coalesce(F.sum("count").over(order), F.lit(0))).where(F.col("above") < drawn).select("score", "above")
    placed = rows.join(F.broadcast(materialise(above)), "score", "left")
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    place = F.col("above") + F.row_number().over(within)
    high = placed.where("able and above is not null").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return high.unionByName(placed.where("not able or above is null").withColumn("rank", F.lit(None).cast("long"))).drop("above")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, most: int = 2, seed: int = 7, doc_id: str | Column = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank.

    Counts are over all rows of both tables. ``percent`` of the rows with ``least_words`` words or more are drawn,
    rounded down; the others' rank is null. Null and empty texts have no features and weight 0. Repeated rows count each and
    have ranks of their own; null ids come last among equal scores. Other columns are not read; an empty table gives
    none, and an empty target counts as the uniform distribution.
    """
    own = materialise(features(docs, doc_id, text, most, buckets))
    count = lambda found: {r.bucket: r.n for r in histogram(found).collect()}  # noqa: E731  # ``buckets`` rows at most
    gain = gains(count(own), count(features(target, F.lit(None), target_text, most, buckets)), buckets)
    rows = materialise(scored(own, gain, seed).withColumn("able", F.col("n_words") >= least_words))
    drawn = rows.where("able").count() * percent // 100
    return ranked(rows, drawn).select("doc_id", "n_features", "weight", "score", "rank")
