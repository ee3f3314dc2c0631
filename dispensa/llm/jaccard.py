"""Exact Jaccard self-join of word n-gram sets, and its components (operator 10).

Universe-partition pigeonhole. Sets are banded by size. In a band, shingles fall into M segments
by hash. A set r and a set s no smaller, of a Jaccard similarity of 3/4 or more, differ in at most
|r| / 3 shingles, so of any |r| // 3 + 1 segments of r at least one is equal in s. Every set of
the band (and those of the next band that are near enough in size) indexes its segment subsets;
r asks with the |r| // 3 + 1 that cost least: those whose subset fewest sets around it share,
then the largest. A set with too few nonempty segments makes some reserved segments
worth two by asking for one-deletion neighbourhoods too; one that still lacks some asks with single
shingles. In small bands each shingle is a segment. Whatever shares a subset is verified exactly, on
64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import LAST, bucket_of, parts, runs, squeeze, unsqueeze
from .components import components
from .kernels import BASE, LOWER, U, chunks, expand, mix, pack, release, rolling, span_hashes, text_bytes, tidy, unpack, word_spans
from .state import materialise

SHORT = 5  # bytes of a subset's hash besides its bucket
SMALL = 7  # bands below 2**7 shingles have a segment for each shingle
SLACK = 1.25  # segments in proportion to those that must be asked for
RESERVED = 4  # segments of a band with one-deletion neighbourhoods
SKETCH = 256, 8192  # bits of a parity sketch, at least and at most; it has more than a set has shingles
BLOCK = 1024  # asking sets of a group that are compared with as many others at once
FOLD = 32  # bytes that all sketches of a block are folded to for a first look
BROADCAST_IDS = 1_000_000  # more ids than these (8 MB) are joined by shuffle
LOCAL = 8 << 20  # bytes of text whose sets are handled together
HEAVY = 64  # sets of a batch that share a subset before the batch sends its bucket one entry for them all
VALUE = 8  # bytes of a shingle's hash in verification
SALTS = 32  # parts that the pairs of one set are dealt to in a join


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingle hashes of each text end to end, their number before each text); fewer words make one shingle."""
    values, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for i, j in chunks(offsets):
        own, o = LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, first = word_spans(own, o)
        w = span_hashes(own, s, e)
        n = np.diff(first)
        h = mix(rolling(w, width))
        owner = np.repeat(np.arange(j - i), n)
        at = np.flatnonzero(np.arange(len(h)) + width <= first[1:][owner[: len(h)]])
        h, owner = h[at], owner[at]
        few = np.flatnonzero((n > 0) & (n < width))
        if len(few):
            whole = np.zeros(len(few), U)
            for k in range(width - 1):
                has = n[few] > k
                whole[has] = mix(whole[has] + w[first[few[has]] + k] + U(k + 1))
            h, owner = np.concatenate([h, mix(whole + U(77))]), np.concatenate([owner, few])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        values.append(h[new])
        sizes.append(np.bincount(owner[new], minlength=j - i))
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def segments(band: int, small: int = SMALL) -> int:
    """Segments of a band; 0: one for each shingle."""
    return 0 if band < small else int(SLACK * (((2 << band) - 1) // 3 + 1))


def signatures(values: np.ndarray, before: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(subset hashes, set of each, whether it asks, sets that could not ask enough)."""
    size = np.diff(before)
    band = np.zeros(len(size), np.int64)
    band[size > 0] = np.floor(np.log2(size[size > 0])).astype(np.int64)
    out, short = [], []
    there = set(band[size > 0].tolist())
    for b in sorted(there | {b - 1 for b in there if b}):
        own = np.flatnonzero((band == b) & (size > 0))
        above = np.flatnonzero((band == b + 1) & (3 * size <= 4 * ((2 << b) - 1)))
        out_b, short_b = _band(values, before, size, b, own, above, segments(b, small))
        out += out_b
        short.append(own[short_b])
    parts = [np.concatenate([np.zeros(0, t), *(x[c] for x in out)]) for c, t in enumerate((U, np.int64, bool))]
    return *parts, np.concatenate([np.zeros(0, np.int64), *short])


def _band(values, before, size, b, own, above, m):
    who = np.concatenate([own, above])
    v = values[expand(before[who], size[who])]
    d = np.repeat(np.arange(len(who)), size[who])
    salt = U(b * 0x9E3779B1 + 1)
    need = size[own] // 3 + 1
    if not m:
        sig, doc, many = mix(v ^ mix(np.full(1, salt, U))), d, np.ones(len(v), np.int64)
        seg = np.zeros(0, np.int64)
    else:
        cell = ((v >> U(32)) * U(m) >> U(32)).astype(np.int64)  # ascends with v
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (cell[1:] != cell[:-1])])) if len(v) else np.zeros(0, np.int64)
        mixed = mix(v + U(0x1234567))
        total = np.add.reduceat(mixed, first) if len(first) else mixed
        doc, seg, many = d[first], cell[first], np.diff(np.append(first, len(v)))
        sig = _sign(total, seg, salt)
    # Allocation: subsets that few sets here share, then large ones; ties by hash.
    _, back, count = np.unique(sig, return_inverse=True, return_counts=True)
    order = np.lexsort((sig, -many, count[back], doc))
    start = np.searchsorted(doc[order], np.arange(len(who) + 1))
    place = np.empty(len(sig), np.int64)
    place[order] = np.arange(len(sig)) - start[doc[order]]
    limit = np.concatenate([need, np.zeros(len(above), np.int64)])
    asks = place < limit[doc]
    out = [(sig, who[doc], asks)]
    lacking = np.maximum(0, need - np.diff(start)[: len(own)])
    if m:
        # Reserved segments: the empty subset and the deletions are indexed by all.
        has = np.zeros((len(who), RESERVED), bool)
        some = np.flatnonzero(seg < RESERVED)
        has[doc[some], seg[some]] = True
        e_doc, e_seg = np.nonzero(~has)
        lone = np.concatenate([lacking, np.zeros(len(above), np.int64)]) > 0
        empty = _sign(np.zeros(len(e_doc), U), e_seg, salt)
        out.append((empty, who[e_doc], lone[e_doc]))
        length = many[some]
        at = expand(first[some], length)
        rest = np.repeat(total[some], length) - mixed[at]
        r_doc, r_seg = np.repeat(doc[some], length), np.repeat(seg[some], length)
        out.append((_sign(rest, r_seg + m, salt), who[r_doc], np.zeros(len(at), bool)))
        ask = lone[r_doc]
        out.append((_sign(rest, r_seg, salt)[ask], who[r_doc][ask], ask[ask]))
        one = lone[doc[some]]
        out.append((_sign(total[some], seg[some] + m, salt)[one], who[doc[some]][one], one[one]))
        none = lone[e_doc]
        out.append((_sign(np.zeros(len(e_doc), U), e_seg + m, salt)[none], who[e_doc][none], none[none]))
        lacking = lacking - (2 * RESERVED - has[: len(own)].sum(1))
    return out, np.flatnonzero(lacking > 0)


def _sign(total: np.ndarray, seg: np.ndarray, salt: U) -> np.ndarray:
    return mix(total + mix(seg.astype(U) * U(0x9E3779B97F4A7C15) + salt))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about LOCAL bytes of text, so that a task's arrays stay small; what one leaves is given back before the next."""
    offsets = text_bytes(batch.column(1))[1]
    for i, j in chunks(offsets, LOCAL):
        yield batch.slice(i, j - i)
        release()


def sketch(values: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit: sketches differ in no more bits than their sets do in shingles."""
    bits = min(SKETCH[1], max(SKETCH[0], 1 << int(np.ceil(np.log2(1.5 * max(len(values), 1))))))
    odd = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """Whether sizes and sketches leave it open that the sets are similar enough."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if len(a) < len(b):
        a, b = b, a
    x, width = int.from_bytes(b), 8 * len(b)
    y = int.from_bytes(a)
    while y:  # a longer sketch is folded to the shorter
        x ^= y & ((1 << width) - 1)
        y >>= width
    # Similar sets differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    return x.bit_count() * (100 + percent) <= (100 - percent) * (n + m)


_FOUND = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
MEMBER, PAIR, LACKING, HELD, LEAD, TOLD = range(6)


def candidates(docs: DataFrame, width: int = 5, small: int = SMALL) -> DataFrame:
    """(kind, x, y, n, sketch). MEMBER: row of document x has n shingles and the set of document y. LACKING: document x could not ask enough.
    HELD: y subsets that many sets of batch x share, in a blob. TOLD: what a bucket tells batch x, in a blob: the least documents that hold
    y of the subsets the batch kept, and n pairs of its documents with the least one that shares a subset that one of them or a third asks with.

    Sets that are much alike share subsets in most buckets. So buckets answer batches, where all that a document shares comes together
    and makes one row for each pair, however many buckets found it."""
    n, heavy = parts(docs), HEAVY

    def blobs(batch: pa.RecordBatch) -> list[tuple]:
        ids = batch.column(0).to_numpy()
        buf, offsets = text_bytes(batch.column(1))
        order = np.argsort(ids, kind="stable")
        values, before = shingle_sets(buf, offsets, width)
        size = np.diff(before)
        total = np.zeros((2, len(ids)), U)
        some = np.flatnonzero(size > 0)
        if len(some):
            total[0, some] = mix(np.add.reduceat(mix(values), before[some]) + size[some].astype(U))
            total[1, some] = np.add.reduceat(mix(values ^ BASE), before[some])
        # Equal sets of a batch (by 128 bits) are one, the smallest document's.
        same = order[np.lexsort((total[1, order], total[0, order]))]
        first = np.union1d(runs(total[0, same]), runs(total[1, same]))
        keeper = np.empty(len(ids), np.int64)
        keeper[same] = np.repeat(same[first], np.diff(np.append(first, len(same))))
        keeper[size == 0] = np.flatnonzero(size == 0)
        lead = np.flatnonzero((keeper == np.arange(len(ids))) & (size > 0))
        sig, doc, asks, short = signatures(values[expand(before[lead], size[lead])], np.concatenate([[0], np.cumsum(size[lead])]), small)
        tag = int(mix(np.array([ids.astype(U).sum() + U(len(ids))], U))[0] >> U(1))
        rows = [(int(ids[0]) % n if len(ids) else 0, MEMBER, tag, squeeze(pack(ids.astype(U), 8) + pack(ids[keeper].astype(U), 8) + pack(size.astype(U), 4)), squeeze(pack(ids[lead[short]].astype(U), 8)), [sketch(values[before[k] : before[k + 1]]) if keeper[k] == k and size[k] else None for k in range(len(ids))])]
        del values
        bucket = bucket_of(sig, n)
        # A subset that many sets here share is one entry, of the least of them; the batch keeps the others until it is told the lead.
        _, back, count = np.unique(sig, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[back] >= heavy)
        if len(many):
            many = many[np.lexsort((ids[lead[doc[many]]], sig[many]))]
            first = runs(sig[many])
            size_of = np.diff(np.append(first, len(many)))
            least, ask = ids[lead[doc[many[first]]]], np.logical_or.reduceat(asks[many], first)
            key = (bucket[many[first]].astype(U) << U(8 * SHORT)) | (sig[many[first]] & U((1 << 8 * SHORT) - 1))
            rows.append((tag % n, HELD, tag, squeeze(pack(key, 8) + pack(size_of.astype(U), 4) + pack(ids[lead[doc[many]]].astype(U), 8) + asks[many].tobytes()), pack(np.array([len(key)], U), 8), None))
            hot = bucket[many[first]]
            order = np.argsort(hot, kind="stable")
            cut = runs(hot[order])
            for at in np.split(order, cut[1:]):
                rows.append((int(hot[at[0]]), LEAD, tag, squeeze(pack(key[at], 8) + pack(least[at].astype(U), 8) + ask[at].tobytes()), pack(np.array([len(at)], U), 8), None))
            rest = np.ones(len(sig), bool)
            rest[many] = False
            sig, doc, asks, bucket = sig[rest], doc[rest], asks[rest], bucket[rest]
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n + 1))
        for k in range(n):
            at = order[cut[k] : cut[k + 1]]
            if len(at):
                at = at[np.argsort(doc[at], kind="stable")]
                own, count = np.unique(doc[at], return_counts=True)
                rows.append((k, PAIR, tag, pack(sig[at], SHORT), squeeze(np.packbits(asks[at]).tobytes().ljust(-(-len(at) // 8)) + pack(ids[lead[own]].astype(U), 8) + pack(count.astype(U), 4)), None))
        return rows

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("tag", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.list_(pa.binary()))])
        for batch in (part for whole in batches for part in _slices(whole)):
            yield from _rows(schema, blobs(batch)).to_batches()  # a slice's arrays are gone before the next slice's are made

    @tidy
    def meet(table: pa.Table) -> pa.Table:
        out, sigs, owners, asking, tags, kept = [(np.zeros(0, np.int64),) * 4], [], [], [], [], []
        sketches: list = []
        for row in range(table.num_rows):
            kind, tag, a, b, c = (table[c][row].as_py() for c in "kind tag a b c".split())
            if kind == HELD:
                out.append((np.full(1, HELD), np.array([tag]), unpack(b, 8), np.zeros(1, np.int64)))
                sketches.append(a)
                continue
            if kind == LEAD:
                k = int(unpack(b, 8)[0])
                a = unsqueeze(a)
                key = unpack(a[: 8 * k], 8)
                sigs.append(key & U((1 << 8 * SHORT) - 1))
                owners.append(unpack(a[8 * k : 16 * k], 8).astype(np.int64))
                asking.append(np.frombuffer(a[16 * k :], bool))
                tags.append(np.full(k, tag, np.int64))
                kept.append(np.ones(k, bool))
                continue
            b = unsqueeze(b)
            if kind == MEMBER:
                a = unsqueeze(a)
                k = len(a) // 20
                out.append((np.full(k, MEMBER), unpack(a[: 8 * k], 8), unpack(a[8 * k : 16 * k], 8), unpack(a[16 * k :], 4)))
                x = unpack(b, 8)
                out.append((np.full(len(x), LACKING), x, x, np.zeros(len(x), np.int64)))
                sketches += [*c, *[None] * len(x)]
                continue
            sig = unpack(a, SHORT)
            head = -(-len(sig) // 8)
            k = (len(b) - head) // 12
            sigs.append(sig)
            owners.append(np.repeat(unpack(b[head : head + 8 * k], 8).astype(np.int64), unpack(b[head + 8 * k :], 4).astype(np.int64)))
            asking.append(np.unpackbits(np.frombuffer(b[:head], np.uint8), count=len(sig)).astype(bool))
            tags.append(np.full(len(sig), tag, np.int64))
            kept.append(np.zeros(len(sig), bool))
        if sigs:
            sig, doc = _joined(sigs), _joined(owners)
            order = np.lexsort((doc, sig))
            sig, doc, asks, tag, heavy = sig[order], doc[order], _joined(asking)[order], _joined(tags)[order], _joined(kept)[order]
            del order
            bucket = U(table["bucket"][0].as_py()) << U(8 * SHORT)
            first = runs(sig)
            size = np.diff(np.append(first, len(sig)))
            wanted = np.logical_or.reduceat(asks, first) & ((size > 1) | np.logical_or.reduceat(heavy, first))
            lead = np.repeat(doc[first], size)
            at = np.flatnonzero(np.repeat(wanted, size) & (heavy | (lead != doc)))
            at = at[np.lexsort((doc[at], lead[at], tag[at]))]
            for own in np.split(at, runs(tag[at])[1:]) if len(at) else ():
                held, own = own[heavy[own]], own[~heavy[own]]
                x, y, a = _once(lead[own], doc[own], asks[own])
                out.append((np.full(1, TOLD), tag[np.append(held, own)[:1]], np.array([len(held)]), np.array([len(x)])))
                sketches.append(squeeze(pack(bucket | sig[held], 8) + pack(lead[held].astype(U), 8) + pack(x.astype(U), 8) + pack(y.astype(U), 8) + a.tobytes()))
        columns = [pa.array(np.concatenate([np.asarray(r[c]).astype(np.int64) for r in out]), _FOUND.field(c).type) for c in range(4)]
        return pa.table([*columns, pa.array(sketches, pa.binary())], schema=_FOUND)

    own = docs.select("doc_id", "text").mapInArrow(spread, "bucket int, kind int, tag long, a binary, b binary, c array<binary>")
    return own.groupBy("bucket").applyInArrow(meet, "kind int, x long, y long, n long, sketch binary")


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    """The arrays end to end; the list is emptied, so that they are not held twice."""
    out = np.concatenate(arrays)
    arrays.clear()
    return out


def _once(x: np.ndarray, y: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of pairs in order, and whether any asks."""
    new = np.union1d(runs(x), runs(y))
    return x[new], y[new], np.logical_or.reduceat(asks, new) if len(new) else asks


def _met(found: DataFrame) -> DataFrame:
    """(x, y, asks): the pairs of ``candidates``, those of subsets that batches kept to themselves included, and whether y asks with what they share."""

    @tidy
    def told(held: pa.Table, leads: pa.Table) -> pa.Table:
        keys, firsts, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
        for k, m, blob in zip(*(leads[c].to_pylist() for c in "y n sketch".split()), strict=True):
            blob = unsqueeze(blob)
            key, lead, x, y = np.split(unpack(blob[: 16 * (k + m)], 8).astype(np.int64), [k, 2 * k, 2 * k + m])
            keys.append(key)
            firsts.append(lead)
            pairs.append(np.stack([x, y, np.frombuffer(blob[16 * (k + m) :], bool)], 1))
        key, lead = np.concatenate(keys), np.concatenate(firsts)
        order = np.argsort(key, kind="stable")
        key, lead = key[order], lead[order]
        for k, blob in zip(held["y"].to_pylist(), held["sketch"].to_pylist(), strict=True):
            blob = unsqueeze(blob)
            own, size = unpack(blob[: 8 * k], 8).astype(np.int64), unpack(blob[8 * k : 12 * k], 4).astype(np.int64)
            m = int(size.sum())
            docs, asks = unpack(blob[12 * k : 12 * k + 8 * m], 8).astype(np.int64), np.frombuffer(blob[12 * k + 8 * m :], bool)
            at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            known = key[at] == own if len(key) else np.zeros(len(own), bool)
            some = np.repeat(known, size)
            x = np.repeat(lead[at] if len(key) else own, size)[some]
            pairs.append(np.unique(np.stack([x, docs[some], asks[some].astype(np.int64)], 1), axis=0))
        x, y, asks = np.concatenate(pairs).T
        order = np.lexsort((y, x))
        order = order[x[order] != y[order]]
        x, y, asks = _once(x[order], y[order], asks[order] > 0)
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "asks": pa.array(asks, pa.bool_())})

    kind = lambda k: found.where(F.col("kind") == k).groupBy("x")
    own = kind(HELD).cogroup(kind(TOLD)).applyInArrow(told, "x long, y long, asks boolean")
    return own.groupBy("x", "y").agg(F.bool_or("asks").alias("asks"))  # rows that share a doc_id can lie in several batches


def _alone(docs: DataFrame, lacking: DataFrame, width: int) -> DataFrame:
    """(x, y): for each document of lacking(doc_id) the documents that hold one of |x| // 3 + 1 of its shingles.

    So few sets lack segments that their shingles are by far the smaller side of the join.
    """

    def shingles(docs: DataFrame, only: str, name: str) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in _slices(whole)):
                values, before = shingle_sets(*text_bytes(batch.column(1)), width)
                size = np.diff(before)
                count = np.where(size > 0, size // 3 + 1, 0) if only == "first" else size
                at = expand(before[:-1], count)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(values[at].view(np.int64))], [name, "h"])

        return docs.select("doc_id", "text").mapInArrow(run, f"{name} long, h long")

    asking = materialise(shingles(docs.join(lacking, "doc_id", "left_semi"), "first", "p"))
    met = shingles(docs, "all", "q").join(asking, "h").where("p <> q")
    return met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles binary) of the documents in ids(doc_id)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            values, before = shingle_sets(*text_bytes(batch.column(1)), width)
            o = before.tolist()
            sets = [pack(np.sort(values[a:b] & U((1 << 8 * VALUE) - 1)), VALUE) for a, b in zip(o, o[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary")


def _dealt(pairs: DataFrame, side: DataFrame, key: str, other: str, how: str = "inner") -> DataFrame:
    """pairs joined with side on key, the pairs of a key dealt to SALTS parts by ``other``, so that those of a hub do not land in one task.

    A row of side is copied once for each part that its key has pairs in: never more often than it has pairs.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = side.join(salted.select(key, "salt").distinct(), key)
    return salted.join(copies, [key, "salt"], how).drop("salt")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that sizes and sketches do not rule out; nothing that is similar enough is lost."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, b, m = (batch.column(k).to_pylist() for k in range(2, 6))
            ok = [may_link(*x, percent) for x in zip(a, n, b, m, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    right = pairs.join(sketches.select(F.col("doc_id").alias("y"), F.col("sketch").alias("b"), F.col("n").alias("m")), "y")
    both = _dealt(right, sketches.select(F.col("doc_id").alias("x"), F.col("sketch").alias("a"), "n"), "x", "y").select("x", "y", "a", "n", "b", "m")
    return both.mapInArrow(run, "x long, y long").distinct()


def _linked(docs: DataFrame, likely: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs among ``likely`` that are links; only their documents' sets are made and moved."""
    likely = materialise(likely)
    ids = materialise(likely.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    return materialise(_verified(likely, _sets(docs, ids, width), percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar: 100 * common >= percent * united."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):  # a pair's sets at a time
                a, b = a.as_py(), b.as_py()
                n = (len(a) + len(b)) // VALUE
                united = len(np.unique(np.concatenate([unpack(a, VALUE), unpack(b, VALUE)])))
                ok.append(100 * (n - united) >= percent * united)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    right = pairs.join(sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("b")), "y")
    both = _dealt(right, sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("a")), "x", "y").select("x", "y", "a", "b")
    return both.mapInArrow(run, "x long, y long").distinct()


def folded(sketches: list[bytes]) -> np.ndarray:
    """All sketches folded to FOLD bytes, as 64-bit words: rows differ in no more bits than the sketches do."""
    out = np.empty((len(sketches), FOLD // 8), U)
    for k, x in enumerate(sketches):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, FOLD // 8), axis=0)
    return out


def _across(pairs: DataFrame, label: DataFrame, sketches: DataFrame, percent: int, lots: int) -> DataFrame:
    """Pairs of sets that meet in a group but are in different components, and that their sketches do not rule out.

    One of a pair has asked with what the group shares, so only those that ask are compared with the
    others, BLOCK with BLOCK in a task.
    """
    named = lambda df, c, other: _dealt(df, label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, other, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    known = named(named(pairs, "x", "y"), "y", "x")
    # The group's least set was compared with all; what it did not link must be compared among itself and with what it linked.
    mixed = known.groupBy("x").agg(F.count_if(F.col("y_in") != F.col("x_in")).alias("apart"), F.count("*").alias("size"), F.count_if("asks").alias("asking")).where("apart > 0 and size > 1 and asking > 0").select("x", "size", "asking")
    group = _dealt(known, mixed, "x", "y").select(F.col("x").alias("g"), F.col("y").alias("doc_id"), F.col("y_in").alias("inside"), "asks", F.ceil(F.col("asking") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("size") / BLOCK).cast("int").alias("columns"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = group.where("asks").select("g", "doc_id", "inside", "asks", place("rows").alias("i"), every("columns").alias("j"))
    asked = group.select("g", "doc_id", "inside", F.lit(False).alias("asks"), every("rows").alias("i"), place("columns").alias("j"))
    # Many small groups share a call.
    ready = asking.unionByName(asked).join(sketches, "doc_id").select(F.pmod(F.xxhash64("g"), F.lit(lots)).alias("lot"), "g", "i", "j", "asks", "doc_id", "inside", "n", "sketch")

    @tidy
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("asks", "descending")])
        groups, ids, inside, n, asks = (table[c].to_numpy() for c in ("g", "doc_id", "inside", "n", "asks"))
        marks, out = table["sketch"].to_pylist(), []
        small, n = folded(marks), n.astype(np.int64)
        first = np.append(runs(groups), len(groups))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            m = a + int(asks[a:b].sum())
            right = np.arange(m, b)
            for k in range(a, m):
                total = n[right] + n[k]
                near = (inside[right] != inside[k]) & (100 * np.minimum(n[right], n[k]) >= percent * np.maximum(n[right], n[k]))
                r = right[near]
                bits = np.bitwise_count(small[r] ^ small[k]).sum(1, dtype=np.int64)
                r = r[bits * (100 + percent) <= (100 - percent) * total[near]]
                out += [(min(ids[k], ids[q]), max(ids[k], ids[q])) for q in r.tolist() if may_link(marks[k], int(n[k]), marks[q], int(n[q]), percent)]
        return pa.table({"x": pa.array([p for p, _ in out], pa.int64()), "y": pa.array([q for _, q in out], pa.int64())})

    return ready.groupBy("lot", "i", "j").applyInArrow(compare, "x long, y long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, its own included).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct shingles of ``width`` words, or
    the whole sequence where there are fewer. Two documents link when 100 * common >= percent *
    united (percent 75 or more). Texts without words, or null, have 0 shingles and are alone. Rows
    that share a doc_id are one node, linked by what any of them links; null ids are one node
    after all others and come back as null. No links are lost: every pair that shares a subset is
    verified unless it is connected already.
    """
    if percent < 75:
        raise ValueError("segments are made for similarities of 0.75 or more")
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"))
    found = materialise(candidates(own, width))
    members = found.where(F.col("kind") == MEMBER).select("x", "y", "n")
    sketches = found.where((F.col("kind") == MEMBER) & F.col("sketch").isNotNull()).select(F.col("x").alias("doc_id"), "n", "sketch")
    pairs = materialise(_met(found))
    direct = pairs.select("x", "y")
    lacking = found.where(F.col("kind") == LACKING).select(F.col("x").alias("doc_id")).distinct()
    if lacking.limit(1).count():
        direct = direct.unionByName(_alone(own, lacking, width)).distinct()
    links = _linked(own, _likely(direct, sketches, percent), width, percent)
    label = components(links)
    more = _linked(own, _across(pairs, label, sketches, percent, max(8, pairs.count() // 20_000)), width, percent)
    # A row has the component of the row that stands for its set; only a shared id whose rows have several sets ties more together.
    several = members.groupBy("x").agg(F.min("y").alias("p"), F.max("y").alias("q")).where("p <> q").select("x")
    ties = more.unionByName(materialise(members.join(several, "x", "left_semi").select("x", "y").where("x <> y")))
    if ties.limit(1).count():
        label = components(label.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(ties))
    out = members.join(label, members["y"] == label["node"], "left")
    return out.select(F.nullif("x", F.lit(LAST)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "y"), F.lit(LAST)).alias("component_id"))
