"""Vectorised text kernels that run inside Arrow tasks: byte buffers, words and rolling hashes.

All take the UTF-8 bytes of many texts laid end to end with their offsets, so that one numpy
call serves many documents. Memory is a small multiple of a chunk, or of one longer text.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text handled at once
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def release() -> None:
    """Give back what this worker no longer uses: workers are kept between stages and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(task):
    """A task function that releases memory once its own arrays are gone."""
    if inspect.isgeneratorfunction(task):

        @functools.wraps(task)
        def run(batches):
            yield from task(batches)
            release()

    elif len(inspect.signature(task).parameters) == 1:

        @functools.wraps(task)
        def run(table):
            try:
                return task(table)
            finally:
                release()

    else:

        @functools.wraps(task)
        def run(one, other):
            try:
                return task(one, other)
            finally:
                release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((BASE, BASE_INV)):
            table = np.full(size, b, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def starts_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """True where a text begins (length n + 1)."""
    mark = np.zeros(n + 1, bool)
    mark[offsets] = True
    return mark


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, words before each text) of the runs of ``[^\\x20\\x09-\\x0D]``."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside, mark = ~SPACE[buf], starts_of(offsets, n)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | mark[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | mark[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span [s, e), from prefix hashes."""
    if not len(buf):
        return np.zeros(len(s), U)
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of values[i : i + width] for every i at which it fits (not mixed)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, part, size, base = np.zeros(n, U), 0, values, 1, BASE
    rest = width
    while rest:
        if rest & 1:
            out = out * base + part[done : done + n]
            done += size
        rest >>= 1
        if rest:
            part = part[:-size] * base + part[size:]
            with np.errstate(over="ignore"):
                base = base * base
            size *= 2
    return out


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over values[i : i + width], for every i at which it fits."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = best(values[:-step], values[step:])
        size += step
    return values


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned 64-bit values."""
    return np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (length[i] of them), for all i, as one array."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


def pieces(data: bytes, size: int, blank: np.ndarray = SPACE) -> Iterator[bytes]:
    """data cut before bytes that are ``blank`` into pieces of about ``size`` bytes; what has no such byte stays whole."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and not blank[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]
