"""Toxicity scores (operator 9): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates suit rare features and the L1 term keeps weights at zero, so
what is left is a table of a few thousand weights that can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, U, chunks, mix, span_hashes, text_bytes, tidy, word_spans
from .state import materialise

DIMENSIONS = 1 << 22
STEMS = 5, 7  # bytes
LEAST = 5  # texts of the sample that a feature must be in to be learned: part of the model, as rarer ones would be learned by heart
SAMPLE = 12_000  # labelled rows that are fitted on, at most: those of smallest hash
SAMPLE_BYTES = 128 << 20  # of their texts; rows behind those that fill it are not fitted on
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.3, 1.0, 12.0, 1.0
BIAS = 0  # the feature that every text has
FOLDED = LOWER.copy()  # punctuation parts words here, so that a comma does not make another word
FOLDED[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all texts end to end, features before each text): words and their stems, pairs of neighbours, and pairs with one word between."""
    low = FOLDED[buf]
    s, e, before = word_spans(low, offsets)
    h = span_hashes(low, s, e)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    parts, owners = [h], [text_of]
    for size in STEMS:  # the first bytes of longer words stand for their inflected and joined forms
        long = np.flatnonzero(e - s > size)
        parts.append(mix(span_hashes(low, s[long], s[long] + size) + U(size)))
        owners.append(text_of[long])
    for gap, salt in ((1, 0xA5A5), (2, 0x5A5A5)):
        same = text_of[gap:] == text_of[:-gap]
        parts.append(mix(h[:-gap] * U(3) + h[gap:] + U(salt))[same])
        owners.append(text_of[gap:][same])
    number = (np.concatenate(parts) % U(DIMENSIONS - 1)).astype(np.int64) + 1
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return number[order], np.searchsorted(owner[order], np.arange(len(offsets)))


class Ftrl:
    """FTRL-proximal: z and n per coordinate, weights derived from them when needed."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = importance * (p - label) * x
        root = np.sqrt(self.n[i])
        self.n[i] += g * g
        self.z[i] += g - (np.sqrt(self.n[i]) - root) / ALPHA * w


def vector(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features with log counts; the bias has the value 1."""
    i, count = np.unique(numbers, return_counts=True)
    return np.append(i, BIAS), np.append(np.log1p(count), 1.0)


def fit(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[int, float]:
    """Nonzero weights, fitted on at most SAMPLE of the rows known(id, label): those whose ids have the smallest hashes.

    The sample is one group of bounded rows and bytes (and its last text), so its pass is the same whatever the corpus.
    Repeated rows of a chosen id come with it, up to SAMPLE rows. Without labels there are no weights.
    """
    ids = docs.select(F.col(doc_id).alias("id")).distinct().join(known, "id").select("id", "label", F.xxhash64("id").alias("h"))
    few = F.broadcast(ids.orderBy("h", "id").limit(SAMPLE))  # SAMPLE narrow rows
    sizes = docs.select(F.col(doc_id).alias("id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("size")).join(few, "id").groupBy("id", "label", "h").agg(F.sum("size").alias("size"))
    upto = Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)  # over SAMPLE narrow rows
    chosen = F.broadcast(sizes.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("before") < SAMPLE_BYTES).select("id", "label", "h"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(chosen, "id")
    sample = rows.select("h", F.col("id").alias("o"), F.col("label").cast("int").alias("y"), "t").withColumn("one", F.lit(0))

    @tidy
    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("o", "ascending"), ("t", "ascending")]).slice(0, SAMPLE)
        y, rows = table["y"].to_numpy(), []
        buf, offsets = text_bytes(table["t"])
        for i, j in chunks(offsets):
            numbers, before = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows += [vector(numbers[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
        texts_with = np.bincount(np.concatenate([np.zeros(1, np.int64), *(i for i, _ in rows)]), minlength=DIMENSIONS)
        texts_with[BIAS] = LEAST
        rows = [(i[ok], x[ok]) for i, x in rows for ok in (texts_with[i] >= LEAST,)]
        model, positive = Ftrl(), max(1, int((y == 1).sum()))
        weight = min(10.0, max(1.0, (len(y) - positive) / positive))
        for _ in range(EPOCHS):
            for (i, x), label in zip(rows, y.tolist(), strict=True):
                model.learn(i, x, label, weight if label else 1.0)
        i = np.flatnonzero(model.n)
        w = model.weights(i)
        return pa.table({"i": pa.array(i[w != 0], pa.int32()), "w": pa.array(w[w != 0])})

    found = sample.groupBy("one").applyInArrow(learn, "i int, w double")
    return {r["i"]: r["w"] for r in materialise(found).collect()}  # at most DIMENSIONS, by L1 far fewer


def score(docs: DataFrame, weights: dict[int, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score in 0..1 (of the whole text; a null text is empty and scores by the bias alone). No shuffle."""
    i = np.fromiter(weights.keys(), np.int64, len(weights))
    shared = docs.sparkSession.sparkContext.broadcast((i, np.fromiter(weights.values(), float, len(weights))))  # at most DIMENSIONS

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIMENSIONS)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                number, before = features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                owner = np.repeat(np.arange(b - a), np.diff(before))
                hit = np.flatnonzero(w[number])
                key, count = np.unique(owner[hit] * DIMENSIONS + number[hit], return_counts=True)
                total = np.bincount(key // DIMENSIONS, w[key % DIMENSIONS] * np.log1p(count), b - a)
                out.append(1 / (1 + np.exp(-np.clip(total + w[BIAS], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id, as text, leaves 1 modulo 3; a null id is held out, so that it is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (score >= cut), learned from labels of rows that are not held out.

    Without any label every text scores one half. Of labels that share a doc_id the largest counts. Null texts are empty.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("label")).where(~held_out("id"))
    weights = fit(docs, known, doc_id, text)
    return score(docs, weights, doc_id, text).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
