"""Vector best-fit packing of documents into training sequences (operator 5)."""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import CHUNK, chunks, release, text_bytes, tidy
from .pretokens import Vocabulary
from .state import arrow_batches, materialise
from .token_counts import Library, is_byte_level, json_vocabulary

WEIGHTS = 1.0, 0.25, 0.25  # of the free tokens, documents and attention cost, in the registered queries
GROUP = 8192  # pieces that one call packs; its last sequences may stay part empty


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> np.ndarray:
    """The bin of each piece, pieces in the order given (longest first packs best).

    A bin has three capacities: tokens, documents, and attention cost (the sum of squared lengths).
    A piece goes to the open bin that meets all three and has the least weighted norm of what would
    stay free (rule "norm") or the largest weighted dot product of free space and piece ("dot");
    ties go to the bin opened first; with none, a new bin is opened, even for a piece that no
    bin could hold by the document or cost limits.
    """
    full, w = np.array([capacity, max_docs, max_cost], float), np.array(weights)
    items = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / full
    least = np.minimum.accumulate(lengths[::-1])[::-1] / capacity if len(lengths) else lengths
    free, number = np.empty((len(lengths) + 1, 3)), np.empty(len(lengths) + 1, np.int64)
    n, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    for k, item in enumerate(items):
        if k % 256 == 0 and n:
            live = free[:n, 0] >= least[k] - 1e-12
            m = int(live.sum())
            free[:m], number[:m], n = free[:n][live], number[:n][live], m
        fits = np.flatnonzero((free[:n] >= item - 1e-12).all(1))
        if len(fits):
            room = free[fits]
            j = fits[np.argmin(((room - item) ** 2) @ w) if rule == "norm" else np.argmax((room * item) @ w)]
        else:
            j, n = n, n + 1
            free[j], number[j], bins = 1.0, bins, bins + 1
        free[j] -= item
        out[k] = number[j]
    return out


def first_tier(spark: SparkSession, file: Broadcast) -> Vocabulary | None:
    """The first tier of a .json tokenizer, None where that is not byte-level.

    A task parses the file, so that the driver holds only the tables made from it: a few MB, as a tokenizer is of fixed size.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json_vocabulary(file.value) if is_byte_level(json.loads(file.value)) else None for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x) for x in made], pa.binary())], ["made"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "made binary").collect()[0]["made"])


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and ``end_id``, cut from its end into pieces of ``capacity``."""
    with open(path) as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer file: of fixed size
    made = first_tier(docs.sparkSession, file)
    if made is None:
        raise ValueError("packing takes byte-level .json tokenizers")
    vocabulary = docs.sparkSession.sparkContext.broadcast(made)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(file.value, vocabulary.value, False)
        release()  # what reading the file took
        for batch in batches:
            own = batch.column(0).to_pylist()
            buf, offsets = text_bytes(batch.column(1))
            rows: list[tuple] = []
            for i, j in chunks(offsets):
                ids, before = library.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, before = ids.astype("<u4"), before.tolist()
                for k in range(j - i):
                    whole = np.append(ids[before[k] : before[k + 1]], np.uint32(end_id))
                    cuts = [0, *range(len(whole) % capacity or min(capacity, len(whole)), len(whole) + 1, capacity)]
                    rows += [(own[i + k], p, a, b - a, zlib.crc32(whole[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            del batch, own, buf, rows  # the next batch comes before these names are given away
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens; one row per piece, see ``pieces``, with sequence_id and offset.

    A row is its ids under the .json tokenizer at ``path``, then ``end_id``; a null text is empty, so
    every row has a token. Unset ``max_docs`` and ``max_cost`` (sum of squared lengths) never bind.
    Pieces are dealt by hash to groups of about GROUP, each packed longest first by one task, so
    no task holds more however many there are; each group may end in one sequence more than it
    must. Repeated rows are packed each for itself; ties go by doc_id and piece. Rows of a full
    sequence's length take one each. Empty tables give none.
    """
    with arrow_batches(docs.sparkSession, 4 * CHUNK):
        cut = materialise(pieces(docs, path, capacity, end_id, doc_id, text))
    # Full pieces have groups of their own, so that however many there are, no group is larger and the others are packed as without them.
    count = cut.agg(F.count_if(F.col("length") < capacity).alias("short"), F.count_if(F.col("length") >= capacity).alias("full")).first()
    groups, full_groups = (max(1, -(-n // GROUP)) for n in count)
    dealt_to = lambda n: F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n))
    dealt = cut.withColumn("bin_group", F.when(F.col("length") < capacity, dealt_to(groups)).otherwise(dealt_to(full_groups) + groups))
    docs_cap, cost_cap = max_docs or capacity, max_cost or float(capacity) ** 2

    def one(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        bins = best_fit(lengths, capacity, docs_cap, cost_cap, weights, rule)
        order = np.argsort(bins, kind="stable")
        done = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = done - np.repeat(done[first], np.diff(np.append(first, len(bins))))
        ids = bins + (key[0].as_py() << 32)
        return table.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("bin_group").applyInArrow(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
