"""Documents dealt to batches, and what batches tell each other through buckets.

A batch is a hash part of the documents, small enough for one task. Jobs that look for text
shared between batches send compact blobs, one for each bucket of hash values, and get an
answer back for each blob. So a key that a third of all documents hold costs a bucket one
entry for each batch, not one for each document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, text_bytes

PART_BYTES = 12 << 20  # text of a batch; grows with the root of the corpus, up to 16 times, so that blobs stay worth their row
LAST = (1 << 63) - 1  # stands for a null doc_id, which ranks after all others

ORDER = [("doc_id", "ascending"), ("text", "ascending")]


def parts(docs: DataFrame, text: str = "text") -> int:
    """The number of batches, or of buckets, that the texts of docs are worth."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    size = PART_BYTES * min(16.0, max(1.0, (total / (PART_BYTES * 1024)) ** 0.5))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / size) + 1)


def deal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """((part, doc_id, text, carried0, carried1, ...), number of parts); rows that share a doc_id share a part."""
    n = parts(docs, text)
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    return docs.select(F.pmod(F.xxhash64(own), F.lit(n)).cast("int").alias("part"), own.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *[F.col(c).alias(f"carried{k}") for k, c in enumerate(carry)]), n


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, bytes, offsets) of a batch, ordered by doc_id and text, however its rows came in."""
    table = table.select(["doc_id", "text"]).sort_by(ORDER)
    buf, offsets = text_bytes(table["text"])
    return table["doc_id"].to_numpy(), buf, offsets


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the highest bits, so hashes in ascending order lie in ascending buckets."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def cuts(h: np.ndarray, n: int) -> list[int]:
    """Where each bucket's hashes begin among ascending hashes, and where the last ends."""
    return np.searchsorted(bucket_of(h, n), np.arange(n + 1)).tolist()


def squeeze(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def unsqueeze(data: bytes) -> bytes:
    return zlib.decompress(data)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def merged(s: np.ndarray, e: np.ndarray, touching: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the intervals [s, e) cover; those that only touch are joined on request."""
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, top = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > top[:-1] - (not touching)])
    first = np.flatnonzero(new)
    return s[first], top[np.append(first[1:], len(s)) - 1]
