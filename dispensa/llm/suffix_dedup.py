"""Suffix-array dedup of byte strings (operator 1).

Two equal strings of WIDTH bytes have the same anchors: the GRAM-byte substrings whose hash is
least in some WIDTH-byte window. So documents first tell each other, through buckets of anchor
hashes, which anchors more than one of them has; then they send the bytes around those
anchors, and each bucket builds two suffix arrays over what it got: one of the suffixes that
start at the anchors, one of the reversed text before them. Suffixes are sorted by mergesort;
a comparison finds the common extension by binary search over prefix polynomial hashes, so it
takes a logarithm of the width. Common extensions of neighbours are checked byte by byte, and
where a hash collided the group is sorted anew by its bytes. Runs of the two arrays give, for
each window over an anchor, the smallest document that holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .batches import LAST, ORDER, cuts, deal, merged, opened, runs, squeeze, unsqueeze
from .kernels import BASE, BYTE_VALUE, U, chunks, mix, pack, rolling, slide, tidy, unpack

GRAM = 24
SHORT = 6  # bytes of an anchor's hash that are sent
HOT = 20_000  # occurrences from which an anchor's windows are dealt out one by one
MOST = 32_767  # occurrences that a batch counts of an anchor: more than HOT, so that one batch is enough to see a hot one
ROWS = 40_000  # contexts whose suffix arrays are built at once


def anchors(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the anchors of every text of at least ``width`` bytes."""
    hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    spread = width - GRAM + 1
    for i, j in chunks(offsets, 1 << 18):
        own, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = len(own)
        if n < width:
            continue
        h = rolling(BYTE_VALUE[own], GRAM) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        least = slide(h, spread, np.minimum)  # of each window
        crossing = np.zeros(len(least), bool)
        for b in o[1:-1]:
            crossing[max(0, b - width + 1) : b] = True
        least[crossing] = 0
        edge = np.zeros(spread - 1, U)
        best = slide(np.concatenate([edge, least, edge]), spread, np.maximum)
        at = np.flatnonzero((best == h) & (h != 0))
        hashes.append(mix(h[at]))
        places.append(at + offsets[i])
    return np.concatenate(hashes), np.concatenate(places)


def hash_sort(rows: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array within groups: the order of rows[i, : length[i]], and each one's common extension with the one before it.

    Rows of a group must be adjacent. Bottom-up mergesort of all groups at once: a row's new
    place is its place in its own run plus its rank in the other run.
    """
    n, width = rows.shape
    value = np.zeros((n, width + 1), U)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(width - 1, BASE, U)]))
    np.cumsum(BYTE_VALUE[rows] * power, axis=1, out=value[:, 1:])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(a), np.int64), np.minimum(length[a], length[b])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = value[a, mid] == value[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(a: np.ndarray, b: np.ndarray, or_same: np.ndarray) -> np.ndarray:
        k = common(a, b)
        end_a, end_b = k == length[a], k == length[b]
        at = np.minimum(k, width - 1)
        return np.where(end_a & end_b, or_same, np.where(end_a | end_b, end_a, rows[a, at] < rows[b, at]))

    first = runs(group)
    size = np.diff(np.append(first, n))
    start, end = np.repeat(first, size), np.repeat(first + size, size)
    order, run = np.arange(n), 1
    while run < size.max(initial=0):
        p = np.flatnonzero(end - start > run)
        q = (p - start[p]) // run
        there = start[p] + (q ^ 1) * run
        lo = np.minimum(there, end[p])
        hi = np.minimum(there + run, end[p])
        base, left = lo.copy(), (q & 1) == 0
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = less(order[mid], order[p[live]], ~left[live])
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
            live = live[lo[live] < hi[live]]
        new = order.copy()
        new[start[p] + (q >> 1) * 2 * run + (p - start[p]) % run + lo - base] = order[p]
        order, run = new, run * 2
    near = np.zeros(n, np.int64)
    inner = np.setdiff1d(np.arange(n), first, assume_unique=True)
    a, b = order[inner - 1], order[inner]
    near[inner] = common(a, b)
    differ = rows[a] != rows[b]
    true = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(length[a], length[b]))
    if (true != near[inner]).any():  # a hash collided: sort by the bytes themselves
        order = np.lexsort([length, *rows.T[::-1], group])
        a, b = order[inner - 1], order[inner]
        differ = rows[a] != rows[b]
        true = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(length[a], length[b]))
    near[inner] = true
    return order, near


def first_holders(group: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray, doc: np.ndarray, width: int):
    """For each offset of a window's start before the anchor: (contexts that have the window, its smallest document)."""
    reach = width - GRAM
    back = np.ascontiguousarray(text[:, :reach][:, ::-1])
    ahead = np.ascontiguousarray(text[:, reach:])
    begin = np.zeros(len(group), bool)
    begin[runs(group)] = True
    ranks = []
    for rows, length in ((back, left), (ahead, right)):
        order, near = hash_sort(rows, length, group)
        ranks.append((order, near))
    for o in range(reach + 1):
        has = np.flatnonzero((left >= o) & (right >= width - o))
        if not len(has):
            continue
        classes = []
        for (order, near), least in zip(ranks, (o, width - o), strict=True):
            new = np.cumsum(begin | (near < least))
            own = np.empty(len(order), np.int64)
            own[order] = new
            classes.append(own[has])
        key = classes[0] << 32 | classes[1]
        sort = np.argsort(key)
        at = runs(key[sort])
        best = np.empty(len(has), np.int64)
        best[sort] = np.repeat(np.minimum.reduceat(doc[has][sort], at), np.diff(np.append(at, len(sort))))
        yield o, has, best


def contexts(buf: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes before the anchor, bytes from it on, both side by side with the anchor in a fixed column) for each place."""
    reach = width - GRAM
    k = np.searchsorted(offsets, place, "right") - 1
    left = np.minimum(reach, place - offsets[k])
    right = np.minimum(width, offsets[k + 1] - place)
    far = np.concatenate([np.zeros(reach, np.uint8), buf, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(far, reach + width)
    text = view[place].copy()
    column = np.arange(reach + width)
    text[(column < reach - left[:, None]) | (column >= reach + right[:, None])] = 0
    return left, right, text


def row_hash(h: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    wide[:, : text.shape[1]] = text
    out = mix(h ^ (left << 8 | right).astype(U))
    for word in wide.view("<u8").T:
        out = mix(out ^ word) + U(1)
    return out


def dedup_bytes(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), removed (array of struct<first, after> of bytes),
    kept_text (without the characters that are removed as a whole: always valid UTF-8), and the columns named in ``carry``, after these.

    A byte of the UTF-8 text goes if a string of ``width`` bytes over it also starts in a document with a
    smaller doc_id; strings are judged on the input, and none crosses a row. A null text is
    empty; a null doc_id ranks last and is returned as null; rows that share a doc_id are one
    document, so they take nothing from each other. Empty tables give none.
    """
    if width < GRAM + 2:
        raise ValueError(f"windows have at least {GRAM + 2} bytes")
    dealt, n = deal(docs, doc_id, text, carry)
    carried = [f"carried{k}" for k in range(len(carry))]
    result = pa.schema([*_RESULT, *to_arrow_schema(dealt.select(carried).schema)])
    blob, reach = "bucket int, part int, data binary, more binary", width - GRAM
    size = reach + width

    @tidy
    def tell(table: pa.Table) -> pa.Table:
        ids, buf, offsets = opened(table)
        h, place = anchors(buf, offsets, width)
        owner = ids[np.searchsorted(offsets, place, "right") - 1] if len(place) else place
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        first = runs(h)
        count = 2 * np.minimum(np.diff(np.append(first, len(h))), MOST)
        if len(h):
            count += 1 * (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first))
        h, at = h[first], cuts(h[first], n)
        rows = [(k, pack(h[a:b], SHORT), squeeze(count[a:b].astype("<u2").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return _blobs(rows, table["part"][0].as_py())

    @tidy
    def shared(table: pa.Table) -> pa.Table:
        """For each blob: 0 for an anchor that one document has, 1 for a shared one, 2 for a hot one."""
        hashes = [unpack(x, SHORT) for x in table["data"].to_pylist()]
        counts = np.concatenate([np.frombuffer(unsqueeze(x), "<u2") for x in table["more"].to_pylist()])
        h, many = np.concatenate(hashes), counts & 1
        order = np.argsort(h)
        first = runs(h[order])
        times = np.diff(np.append(first, len(h)))
        total = np.add.reduceat((counts >> 1)[order], first, dtype=np.int64)
        verdict = (np.add.reduceat(many[order], first, dtype=np.int64) > 0) | (times > 1)
        out = np.empty(len(h), np.uint8)
        out[order] = np.repeat(verdict.astype(np.uint8) + (verdict & (total > HOT)), times)
        done = np.cumsum([0, *map(len, hashes)])
        m = table.num_rows
        return pa.table({"bucket": table["bucket"].cast(pa.int32()), "part": table["part"].cast(pa.int32()), "data": pa.array([squeeze(out[a:b].tobytes()) for a, b in zip(done, done[1:], strict=False)], pa.binary()), "more": pa.array([b""] * m, pa.binary())})

    @tidy
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _blobs([], 0)
        ids, buf, offsets = opened(table)
        h, place = anchors(buf, offsets, width)
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        first = runs(h)
        u = h[first]
        verdict, cut = np.zeros(len(u), np.uint8), cuts(u, n)
        for k, data in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True):
            verdict[cut[k] : cut[k + 1]] = np.frombuffer(unsqueeze(data), np.uint8)
        verdict = np.repeat(verdict, np.diff(np.append(first, len(h))))
        entries = [_entries(h[verdict > 0], place[verdict > 0], verdict[verdict > 0], ids, buf, offsets, width)]
        h, left, right, text, doc, count, places, later = (np.concatenate(x) for x in zip(*entries, strict=True))
        rows, at, done = [], cuts(h, n), np.concatenate([[0], np.cumsum(count)])
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                c, d = done[a], done[b]
                head = pack(h[a:b], SHORT) + pack(doc[a:b].astype(U), 8) + pack(count[a:b].astype(U), 4) + left[a:b].astype(np.uint8).tobytes() + right[a:b].astype(np.uint8).tobytes() + text[a:b].tobytes()
                rows.append((k, squeeze(head), pack(places[c:d].astype(U), 4) + np.packbits(later[c:d]).tobytes()))
        return _blobs(rows, table["part"][0].as_py())

    @tidy
    def decide(table: pa.Table) -> pa.Table:
        heads, counts_of = [], []
        for data in table["data"].to_pylist():
            data = unsqueeze(data)
            k = len(data) // (SHORT + 14 + size)
            cut = np.cumsum([0, SHORT * k, 8 * k, 4 * k, k, k, size * k]).tolist()
            part = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            heads.append((unpack(part[0], SHORT), unpack(part[1], 8).astype(np.int64), unpack(part[2], 4).astype(np.int64), np.frombuffer(part[3], np.uint8).astype(np.int64), np.frombuffer(part[4], np.uint8).astype(np.int64), np.frombuffer(part[5], np.uint8).reshape(k, size)))
            counts_of.append(k)
        h, doc, count, left, right, text = (np.concatenate(x) for x in zip(*heads, strict=True))
        del heads
        lo, hi = np.maximum(0, width - right), np.minimum(reach, left)  # windows that an entry has
        some, least, most = np.zeros(len(h), bool), np.full(len(h), 255), np.full(len(h), -1)
        # The same context from several batches is one row of the suffix arrays, with its smallest document.
        key = row_hash(h, left, right, text)
        order = np.lexsort((key, h))
        h2, key2 = h[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (h2[1:] != h2[:-1]) | (key2[1:] != key2[:-1])]))
        row_of = np.empty(len(h), np.int64)
        row_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        smallest, one = np.minimum.reduceat(doc[order], first), order[first]
        hs = h[one]
        groups = np.append(runs(hs), len(hs))
        by_row = np.argsort(row_of, kind="stable")
        row_start = np.append(np.flatnonzero(np.diff(row_of[by_row], prepend=-1)), len(h))
        a = 0
        while a < len(hs):
            b = int(groups[np.searchsorted(groups, min(a + ROWS, len(hs)), "left")])  # whole groups
            rows = one[a:b]
            members = by_row[row_start[a] : row_start[b]]
            for o, has, best in first_holders(hs[a:b], left[rows], right[rows], np.ascontiguousarray(text[rows]), smallest[a:b], width):
                holder = np.full(b - a, LAST, np.int64)
                holder[has] = best
                hit = members[holder[row_of[members] - a] < doc[members]]
                some[hit] = True
                least[hit], most[hit] = np.minimum(least[hit], o), np.maximum(most[hit], o)
            a = b
        parts, out, done, e = table["part"].to_pylist(), [], np.concatenate([[0], np.cumsum(counts_of)]), 0
        for k, more in enumerate(table["more"].to_pylist()):
            own = slice(done[k], done[k + 1])
            total = int(count[own].sum())
            place = unpack(more[: 4 * total], 4).astype(np.int64)
            later = np.unpackbits(np.frombuffer(more[4 * total :], np.uint8), count=total).astype(bool)
            e = np.repeat(np.arange(done[k], done[k + 1]), count[own])
            has = np.where(later, lo[e] <= hi[e], some[e])
            s = place - np.where(later, hi[e], most[e])
            t = place + width - np.where(later, lo[e], least[e])
            s, t = merged(s[has], t[has], False)  # texts lie end to end
            if len(s):
                out.append((parts[k], squeeze(pack(s.astype(U), 4) + pack(t.astype(U), 4))))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    @tidy
    def finish(table: pa.Table, spans: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        table = table.sort_by(ORDER)
        ids, buf, offsets = opened(table)
        pairs = [np.zeros((2, 0), np.int64)] + [unpack(unsqueeze(d), 4).astype(np.int64).reshape(2, -1) for d in spans["data"].to_pylist()]
        s, t = np.concatenate(pairs, 1)
        data, rows, o = buf.tobytes(), [], offsets.tolist()
        k = np.searchsorted(offsets, s, "right") - 1
        order = np.argsort(k, kind="stable")
        at = np.searchsorted(k[order], np.arange(len(ids) + 1))
        for i in range(len(ids)):
            x, y = merged(s[order[at[i] : at[i + 1]]], t[order[at[i] : at[i + 1]]])
            chars = "".join([data[p:q].decode("utf-8", "replace") for p, q in _between(*_whole(x, y, buf, o[i + 1]), o[i], o[i + 1])]) if len(x) else data[o[i] : o[i + 1]].decode("utf-8", "replace")
            x, y = x.tolist(), y.tolist()
            kept = b"".join([data[p:q] for p, q in _between(x, y, o[i], o[i + 1])])
            rows.append((int(ids[i]), o[i + 1] - o[i], o[i + 1] - o[i] - len(kept), len(x), hashlib.sha256(kept).hexdigest(), kept, [{"first": p - o[i], "after": q - o[i]} for p, q in zip(x, y, strict=True)], chars))
        own = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)]
        return pa.Table.from_arrays([*own, *(table[c] for c in carried)], names=result.names)

    by_part = dealt.groupBy("part")
    answers = by_part.applyInArrow(tell, blob).groupBy("bucket").applyInArrow(shared, blob)
    found = by_part.cogroup(answers.groupBy("part")).applyInArrow(send, blob)
    spans = found.groupBy("bucket").applyInArrow(decide, "part int, data binary")
    done = by_part.cogroup(spans.groupBy("part")).applyInArrow(finish, from_arrow_schema(result))
    return done.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), *_RESULT.names[1:], *[F.col(a).alias(b) for a, b in zip(carried, carry, strict=True)])


def _whole(x: np.ndarray, y: np.ndarray, buf: np.ndarray, end: int) -> tuple[list[int], list[int]]:
    """The spans [x, y) without the characters that they cut through."""
    inside = lambda p: (p < end) & ((buf[np.minimum(p, len(buf) - 1)] & 0xC0) == 0x80)
    for _ in range(3):
        x, y = x + inside(x), y - inside(y)
    ok = x < y
    return x[ok].tolist(), y[ok].tolist()


def _between(x: list[int], y: list[int], start: int, end: int) -> list[tuple[int, int]]:
    """What the spans [x, y) leave of [start, end)."""
    edges = [start, *(v for p in zip(x, y, strict=True) for v in p), end]
    return list(zip(edges[::2], edges[1::2], strict=True))


def _entries(h, place, verdict, ids, buf, offsets, width):
    """The distinct contexts of a batch, ascending by the hash that deals them out, with all places of each.

    A hot anchor's context becomes one entry for each window over it, dealt out by the window's own
    hash, so that no bucket gets all that surround the anchor.
    """
    reach = width - GRAM
    left, right, text = contexts(buf, offsets, place, width)
    hot = np.flatnonzero(verdict == 2)
    if len(hot):
        column, parts = np.arange(reach + width), []
        for o in range(reach + 1):
            ok = hot[(left[hot] >= o) & (right[hot] >= width - o)]
            own = text[ok]
            own[:, (column < reach - o) | (column >= reach - o + width)] = 0
            l, r = np.full(len(ok), o), np.full(len(ok), width - o)
            parts.append((row_hash(h[ok], l, r, own), place[ok], l, r, own))
        cold = np.flatnonzero(verdict == 1)
        parts.append((h[cold], place[cold], left[cold], right[cold], text[cold]))
        h, place, left, right, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = ids[np.searchsorted(offsets, place, "right") - 1] if len(place) else place
    key = row_hash(h, left, right, text)
    order = np.lexsort((place, key, h))  # places ascend with doc_id
    h, key, place, owner = h[order], key[order], place[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    one = order[first]
    return h[first], left[one], right[one], text[one], owner[first], count, place, owner > np.repeat(owner[first], count)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), ("kept_text", pa.string())])


def _blobs(rows: list[tuple[int, bytes, bytes]], part: int) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary())})
