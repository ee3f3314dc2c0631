"""Byte-level BPE encoding and decoding of whole columns (operator 2).

Two-tier lookup: a minimal perfect hash resolves pre-tokens that are vocabulary entries;
every other distinct pre-token of a chunk is merged once with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .kernels import chunks, text_bytes, tidy
from .pretokens import Vocabulary, flat_ids, resolve

REMEMBERED = 1_000_000  # merged pieces that a worker keeps; beyond it the memory is emptied and filled anew


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a .tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked neighbours, leftmost first, until none can be merged.

    The parts form a linked list: after[i] is where the part that starts at i ends and the
    next one starts. A heap entry (rank, start, end) is stale unless start still opens a part
    whose neighbour ends at ``end``.
    """
    n, get = len(piece), ranks.get
    after, prior, opens = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    # An entry is one integer, rank above start above end.
    heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, end = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
        if not opens[i] or (j := after[i]) >= n or after[j] != end:
            continue
        opens[j], after[i] = False, end
        if end < n:
            prior[end] = i
            far = after[end]
            if (r := get(piece[i:far])) is not None:
                heappush(heap, r << 64 | i << 32 | far)
        if (k := prior[i]) >= 0 and (r := get(piece[k:end])) is not None:
            heappush(heap, r << 64 | k << 32 | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes chunks in one worker; merged pieces are remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], vocabulary: Vocabulary):
        self.ranks, self.vocabulary, self.memory = ranks, vocabulary, {}

    def second(self, todo: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 4-byte integers laid end to end."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        out = []
        for piece in todo:
            if (got := self.memory.get(piece)) is None:
                whole = self.ranks.get(piece)  # entries too long for the first tier
                got = array("i", [whole] if whole is not None else heap_merge(piece, self.ranks)).tobytes()
                if len(piece) <= 64:
                    self.memory[piece] = got
            out.append(got)
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids before each text)."""
        ids, which, missed, before = resolve(buf, offsets, self.vocabulary, self.second)
        return flat_ids(ids, which, missed, before)


def _shared(df: DataFrame, path: str):
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((ranks, Vocabulary(ranks)))  # the size of the vocabulary file


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append ``out``: array<int> of the ids of ``text`` under the .tiktoken ranks at ``path``, no special tokens.

    A null or empty text gives an empty array. Other columns pass through, ``out`` replaces a
    column of that name. Rows are encoded where they lie: no shuffle. An empty table gives none.
    """
    df = df.drop(out)
    shared = _shared(df, path)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(text))
            for i, j in chunks(offsets):
                ids, before = encoder.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out``: binary, the bytes of the ids; null or empty arrays give no bytes, unknown ids raise KeyError."""
    df = df.drop(out)
    shared = _shared(df, path)
    schema = StructType([*df.schema.fields, StructField(out, BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in shared.value[0].items()}
        for batch in batches:
            got = [b"".join(map(table.__getitem__, x or ())) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens, and SHA-256 (lowercase hex) of the decimal ids and of the bytes they decode to.

    Encodes and decodes in one pass, so ids never leave the task. Null texts count as empty.
    """
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = _shared(df, path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, vocabulary = shared.value
        encoder = Encoder(ranks, vocabulary)
        size = max(ranks.values(), default=0) + 1
        as_text, as_bytes = [str(k) for k in range(size)], [b""] * size
        for k, v in ranks.items():
            as_bytes[v] = k
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            counts, one, two = [], [], []
            for i, j in chunks(offsets):
                ids, before = encoder.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, before = ids.tolist(), before.tolist()
                for a, b in zip(before, before[1:], strict=False):
                    own = ids[a:b]
                    counts.append(b - a)
                    one.append(hashlib.sha256(" ".join([as_text[x] for x in own]).encode()).hexdigest())
                    two.append(hashlib.sha256(b"".join([as_bytes[x] for x in own])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
