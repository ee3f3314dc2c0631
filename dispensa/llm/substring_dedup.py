"""Removal of word windows that were seen before (operator 6).

Rabin-Karp hashes of every window of ``width`` words are counted across batches: first by
five bytes of the hash, to set aside the windows that occur once, then by two whole hashes (128
bits) with the place of each batch's first occurrence. Repeated windows merge into removal intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import LAST, cuts, deal, merged, opened, runs, squeeze, unsqueeze
from .kernels import BASE, U, chunks, mix, pack, rolling, span_hashes, tidy, unpack, word_spans

SHORT = 5  # bytes of a hash in the first count


def batch_windows(buf: np.ndarray, offsets: np.ndarray, width: int, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, its second hash if asked for, index of its first word in the batch, words before each text)."""
    hashes, more, places, before, done = [], [], [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(offsets):
        own, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = word_spans(own, o)
        w = span_hashes(own, s, e)
        h = mix(rolling(w, width))
        n = np.diff(first)
        at = np.flatnonzero(np.arange(len(h)) + width <= np.repeat(first[1:], n)[: len(h)])
        hashes.append(h[at])
        if twice:
            more.append(mix(rolling(mix(w ^ BASE), width))[at])
        places.append(at + done)
        before.append(first[1:] + done)
        done += len(s)
    return np.concatenate([np.zeros(0, U), *hashes]), np.concatenate([np.zeros(0, U), *more]), np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate(before)


def dedup_windows(docs: DataFrame, width: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, removed (array of struct<first, after> of word numbers).

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window over it has the words of a window that
    starts earlier: in a smaller doc_id, or before it in the same document. Rows that share a
    doc_id are parts of one document in the order of their texts; no window crosses rows; a null
    doc_id ranks last and is returned as null. A null text has no words; its hash is of no bytes. Other columns are not read.
    Windows are the same if 128 bits of their hashes are; the words themselves are not compared.
    """
    dealt, n = deal(docs, doc_id, text)
    blob = "bucket int, part int, kind int, data binary"

    @tidy
    def first_count(table: pa.Table) -> pa.Table:
        _, buf, offsets = opened(table)
        h, *_ = batch_windows(buf, offsets, width)
        h, counts = np.unique(h, return_counts=True)
        at = cuts(h, n)
        rows = [(k, 0, pack(h[a:b], SHORT) + np.packbits(counts[a:b] > 1).tobytes()) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return _blobs(rows, table["part"][0].as_py())

    @tidy
    def repeated(table: pa.Table) -> pa.Table:
        parts, sizes, hashes, twice = table["part"].to_pylist(), [], [], []
        for data in table["data"].to_pylist():
            k = _entries(len(data), SHORT)
            sizes.append(k)
            hashes.append(unpack(data[: k * SHORT], SHORT))
            twice.append(np.unpackbits(np.frombuffer(data[k * SHORT :], np.uint8), count=k))
        h, twice = np.concatenate(hashes), np.concatenate(twice)
        order = np.argsort(h)
        first = runs(h[order])
        many = np.maximum(np.add.reduceat(twice[order], first, dtype=np.int64), np.diff(np.append(first, len(h))) > 1) > 0
        shared = np.empty(len(h), bool)
        shared[order] = np.repeat(many, np.diff(np.append(first, len(h))))
        done = np.concatenate([[0], np.cumsum(sizes)])
        bucket = table["bucket"][0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(parts), pa.int32()), "part": pa.array(parts, pa.int32()), "kind": pa.array([0] * len(parts), pa.int32()), "data": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(done, done[1:], strict=False)], pa.binary())})

    @tidy
    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _blobs([], 0)
        ids, buf, offsets = opened(table)
        part = table["part"][0].as_py()
        h, g, place, before = batch_windows(buf, offsets, width, True)
        order = np.lexsort((g, h))  # stable, so the first of a run is the earliest: places ascend with doc_id
        hs, gs, place = h[order], g[order], place[order]
        short = runs(hs)
        first = np.union1d(short, runs(gs))
        shared = np.repeat(_answered(answers, hs[short], n), np.diff(np.append(short, len(hs))))[first]
        later = np.ones(len(hs), bool)
        later[first] = False
        rows = [(part % n, 1, squeeze(pack(np.sort(place[later]).astype(U), 4)))] if later.any() else []
        u, v, at = hs[first][shared], gs[first][shared], place[first][shared]
        owner = ids[np.searchsorted(before, at, "right") - 1] if len(at) else at
        cut = cuts(u, n)
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a:
                rows.append((k, 2, pack(u[a:b], 8) + pack(v[a:b], 8) + pack(owner[a:b].astype(U), 8) + pack(at[a:b].astype(U), 4)))
        return _blobs(rows, part)

    @tidy
    def decide(table: pa.Table) -> pa.Table:
        kinds, parts, data = (table[c].to_pylist() for c in ("kind", "part", "data"))
        out = [(p, d) for k, p, d in zip(kinds, parts, data, strict=True) if k == 1]
        own = [(p, d) for k, p, d in zip(kinds, parts, data, strict=True) if k == 2]
        if own:
            sizes = [len(d) // 28 for _, d in own]
            h, g, doc = (np.concatenate([unpack(d[8 * c * k : 8 * (c + 1) * k], 8) for (_, d), k in zip(own, sizes, strict=True)]) for c in range(3))
            at = np.concatenate([unpack(d[24 * k :], 4) for (_, d), k in zip(own, sizes, strict=True)])
            order = np.lexsort((doc.astype(np.int64), g, h))  # a doc_id is in one part only, so a window has one entry for it
            later = np.ones(len(h), bool)
            later[order[np.union1d(runs(h[order]), runs(g[order]))]] = False
            done = np.concatenate([[0], np.cumsum(sizes)])
            out += [(p, squeeze(pack(np.sort(at[a:b][later[a:b]]), 4))) for (p, _), a, b in zip(own, done, done[1:], strict=False) if later[a:b].any()]
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    @tidy
    def finish(table: pa.Table, places: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _RESULT})
        ids, buf, offsets = opened(table)
        at = np.concatenate([np.zeros(0, np.int64), *(unpack(unsqueeze(d), 4).astype(np.int64) for d in places["data"].to_pylist())])
        begin, end = merged(at, at + width)
        rows, done = [], 0
        data = buf.tobytes()
        for i, j in chunks(offsets):
            s, e, first = word_spans(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            s, e, first = s + offsets[i], e + offsets[i], first.tolist()
            for k in range(j - i):
                a, b = first[k] + done, first[k + 1] + done
                lo, hi = (np.searchsorted(end, a, "right"), np.searchsorted(begin, b)) if b > a else (0, 0)
                x, y = np.maximum(begin[lo:hi], a) - a, np.minimum(end[lo:hi], b) - a
                ss, ee = s[first[k] : first[k + 1]], e[first[k] : first[k + 1]]
                keep = np.ones(b - a, bool)
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    keep[p:q] = False
                kept = b" ".join([data[p:q] for p, q in zip(ss[keep].tolist(), ee[keep].tolist(), strict=True)])
                doc = int(ids[i + k])
                rows.append((doc, b - a, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), [{"first": p, "after": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)]))
            done += len(s)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

    by_part = dealt.groupBy("part")
    answers = by_part.applyInArrow(first_count, blob).groupBy("bucket").applyInArrow(repeated, blob)
    found = by_part.cogroup(answers.groupBy("part")).applyInArrow(candidates, blob)
    places = found.groupBy("bucket").applyInArrow(decide, "part int, data binary")
    done = by_part.cogroup(places.groupBy("part")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,after:long>>")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))])


def _entries(size: int, width: int) -> int:
    """Of a blob of so many bytes, with ``width`` bytes and one bit for each entry."""
    k = size * 8 // (8 * width + 1)
    while k * width + -(-k // 8) > size:
        k -= 1
    return k


def _blobs(rows: list[tuple[int, int, bytes]], part: int) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _answered(answers: pa.Table, h: np.ndarray, n: int) -> np.ndarray:
    """The answers' bits for the batch's distinct hashes, which ascend."""
    out = np.zeros(len(h), bool)
    cut = cuts(h, n)
    for k, data in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True):
        a, b = cut[k], cut[k + 1]
        out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a)
    return out
