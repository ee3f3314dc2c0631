"""Byte-level BPE pieces found for whole chunks of text at once, and the tables that resolve them.

A chunk's pre-tokens (the pattern of public_tokenizers.PATTERN) are found with array
operations on its bytes. ``Vocabulary`` is the first tier of a two-tier lookup: a minimal
perfect hash over the vocabulary's own entries, checked byte for byte. Whatever misses is
handed, once per distinct piece of a chunk, to a second tier that the caller supplies.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .kernels import U, expand, mix, starts_of

LONGEST = 24  # bytes of the pieces that the first tier can hold
LETTER, NUMBER, BLANK = 1, 2, 3
# The white space of the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.fromiter((b"LN".find(unicodedata.category(chr(c))[0].encode()) + 1 for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = BLANK
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = classes()
    out = table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        wide = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
        a, b, c, d = (wide[lead + k] for k in range(4))
        size = 2 + (a >= 0xE0) + (a >= 0xF0)
        code = np.select([size == 2, size == 3], [(a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63], (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)
        kind = table[np.minimum(code, 0x10FFFF)]
        out[lead] = kind
        for k in (1, 2, 3):
            at = lead[size > k] + k
            ok = at < len(buf)
            out[at[ok]] = kind[size > k][ok]
    return out


def pieces(buf: np.ndarray, offsets: np.ndarray, special: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, bytes after the last) of the pre-tokens; none crosses a text's end. Each ``special`` string is one piece."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = starts_of(offsets, n)
    whole = []
    if special and special in (data := buf.tobytes()):
        for m in re.finditer(re.escape(special), data):
            if not mark[m.start() + 1 : m.end()].any():
                whole.append(m.span())
                mark[[m.start(), m.end()]] = True
    kind = byte_classes(buf)
    start = mark[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A blank before other text goes with it if it is one space; any other last blank of a run stands alone.
    run = np.flatnonzero(start & (kind != BLANK) & ~mark[:n])
    run = run[kind[run - 1] == BLANK]
    before = run - 1
    for _ in range(3):
        before = before - ((buf[before] & 0xC0) == 0x80)
    start[before] = True
    start[run[buf[before] == 0x20]] = False
    # Contractions: an apostrophe that opens a piece, and the letters that follow.
    far = np.concatenate([buf, np.zeros(4, np.uint8)])
    ends = np.concatenate([mark, np.ones(4, bool)])
    quote = np.flatnonzero(start & (buf == 0x27))
    quote = quote[~ends[quote + 1]]
    one, two = far[quote + 1], far[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    pair = one.astype(np.int64) * 256 + two
    longer = np.isin(pair, [0x7265, 0x7665, 0x6C6C]) & ~ends[quote + 2]
    start[quote[short | longer] + 1] = False
    after = np.where(short, quote + 2, quote + 3)[short | longer]
    start[after[after < n]] = True
    for s, e in whole:
        start[s + 1 : e] = False
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def key_words(buf: np.ndarray, s: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 24 bytes of each piece as three integers, zero beyond its end."""
    far = np.concatenate([buf, np.zeros(LONGEST + 8, np.uint8)])
    at = np.ndarray((len(far) - 7,), "<u8", far, 0, (1,))
    return tuple(at[s + 8 * k] & _MASK[np.clip(length - 8 * k, 0, 8)] for k in range(3))


def key_hash(words, length: np.ndarray) -> np.ndarray:
    a, b, c = words
    return mix(a * U(0x9E3779B97F4A7C15) ^ mix(b + U(0x632BE59BD9B4E019)) ^ mix(c * U(0xD6E8FEB86659FD93) + length.astype(U)))


class Vocabulary:
    """Minimal perfect hash from byte strings (at most 24 bytes) to ids; its size is that of the vocabulary, whatever the corpus."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = [k for k in ranks if len(k) <= LONGEST]
        buf = np.frombuffer(b"".join(keys), np.uint8)
        length = np.array([len(k) for k in keys])
        words = key_words(buf, np.cumsum(length) - length, length)
        h, self.n = key_hash(words, length), len(keys)
        self.buckets = max(1, self.n // 4)
        bucket = self._scaled(h >> U(32), self.buckets)
        self.shift = np.zeros(self.buckets, np.int64)
        slot = np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        free, tries = np.ones(self.n, bool), np.arange(1, 257)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[first[b] : first[b] + sizes[b]]
            if len(own) < 2:
                break
            base = 0
            while True:
                at = self._slot(h[own][None, :], (tries + base)[:, None])
                good = free[at].all(1)
                for k in np.flatnonzero(good):
                    if len(set(at[k])) == len(own):
                        break
                else:
                    base += len(tries)
                    continue
                self.shift[b], slot[own] = tries[k] + base, at[k]
                free[at[k]] = False
                break
        single = order[first[sizes == 1]]
        slot[single] = np.flatnonzero(free)
        self.shift[bucket[single]] = -1 - slot[single]
        to = np.argsort(slot)
        self.words, self.length = [w[to] for w in words], length[to]
        self.ids = np.array([ranks[k] for k in keys], np.int64)[to]

    @staticmethod
    def _scaled(h: np.ndarray, n: int) -> np.ndarray:
        return ((h * U(n)) >> U(32)).astype(np.int64)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return self._scaled(mix(h + shift.astype(U) * U(0x9E3779B97F4A7C15)) >> U(32), self.n)

    def find(self, words, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The id of each piece, or -1."""
        shift = self.shift[self._scaled(h >> U(32), self.buckets)]
        at = np.where(shift < 0, -1 - shift, self._slot(h, np.maximum(shift, 0)))
        same = self.length[at] == length
        for mine, theirs in zip(self.words, words, strict=True):
            same &= mine[at] == theirs
        return np.where(same, self.ids[at], -1)


def resolve(buf: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, second: Callable[[list[bytes]], list], special: bytes | None = None):
    """Pieces of a chunk, each with an id (or -1) and, where -1, an index into the distinct misses that ``second`` has encoded.

    Returns (ids, index of the miss, what ``second`` returned, pieces before each text).
    """
    s, e = pieces(buf, offsets, special)
    length, before = e - s, np.searchsorted(s, offsets)
    words = key_words(buf, s, length)
    h = key_hash(words, length)
    ids = vocabulary.find(words, length, h)
    ids[length > LONGEST] = -1
    del words
    which = np.zeros(len(ids), np.int64)
    miss = np.flatnonzero((ids < 0) & (length <= LONGEST))
    _, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
    which[miss] = back
    todo = [buf[a:b].tobytes() for a, b in zip(s[miss[at]].tolist(), e[miss[at]].tolist(), strict=True)]
    known: dict[bytes, int] = {}
    for k in np.flatnonzero(length > LONGEST).tolist():
        text = buf[s[k] : e[k]].tobytes()
        which[k] = known.setdefault(text, len(todo) + len(known))
    del s, e, length, h, miss, at, back  # ``second`` needs room of its own
    return ids, which, second([*todo, *known]), before


def flat_ids(ids: np.ndarray, which: np.ndarray, missed: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts end to end, tokens before each text); missed: 4-byte ids of each distinct miss."""
    sizes = np.array([len(x) // 4 for x in missed], np.int64)
    store = np.frombuffer(b"".join(missed), np.int32)
    first = np.cumsum(sizes) - sizes
    miss = ids < 0
    length = np.ones(len(ids), np.int64)
    length[miss] = sizes[which[miss]]
    done = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(done[-1], np.int64)
    out[done[:-1][~miss]] = ids[~miss]
    out[expand(done[:-1][miss], length[miss])] = store[expand(first[which[miss]], length[miss])]
    return out, done[before]
