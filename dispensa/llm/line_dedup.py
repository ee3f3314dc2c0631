"""Reversible line dedup (operator 4).

State is an exact table of postings, one row per (line key, document), from which reference
counts and first holders follow; documents can be inserted and deleted at any time, and only the
keys they hold are counted anew. Keys that at least two documents hold are also kept in sharded
cuckoo filters, a table of one blob a shard, which insertions and deletions update. Lines are sorted
to their shard's filter and stream past it. A filter has no false negatives, so a line that misses
it needs no look at the exact counts; every line that hits it is decided by them.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .kernels import U, mix, tidy
from .state import materialise

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)
LEAST = 10  # code points of a key that can be dropped
PER_SHARD = 40_000  # keys that one filter is made for
SALTS = 32  # copies of a filter, so that a line which very many documents hold streams through as many tasks
LAST = (1 << 63) - 1  # stands for a null doc_id, which ranks after all others


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def plain_key(line: str) -> str:
    return line.strip(STRIPPED).translate(_TO_LOWER)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; supports add, remove and vectorised lookup."""

    SLOTS = 4

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, self.SLOTS).copy()

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / cls.SLOTS / 0.8)))))

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and the two buckets of each 64-bit hash."""
        mark = (h >> U(48)).astype(np.int64) | 1
        one = (h & U(self.buckets - 1)).astype(np.int64)
        return mark, one, one ^ self._other(mark)

    def _other(self, mark):
        return (mark * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def add(self, h: np.ndarray) -> bool:
        """False if no place was found (the caller then makes a larger filter from the exact table)."""
        rows, rng = self.table.tolist(), Random(1)
        for mark, i, j in zip(*(x.tolist() for x in self.places(h)), strict=True):
            for _ in range(500):
                if 0 in rows[i]:
                    rows[i][rows[i].index(0)] = mark
                    break
                if 0 in rows[j]:
                    rows[j][rows[j].index(0)] = mark
                    break
                k, i = rng.randrange(self.SLOTS), rng.choice((i, j))
                mark, rows[i][k] = rows[i][k], mark
                i, j = i ^ self._other(mark), i
            else:
                return False
        self.table = np.array(rows, np.uint16).reshape(self.buckets, self.SLOTS)
        return True

    def remove(self, h: np.ndarray) -> None:
        for mark, i, j in zip(*(x.tolist() for x in self.places(h)), strict=True):
            for b in (i, j):
                at = np.flatnonzero(self.table[b] == mark)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    def has(self, h: np.ndarray) -> np.ndarray:
        mark, i, j = self.places(h)
        return ((self.table[i] == mark[:, None]) | (self.table[j] == mark[:, None])).any(1)


def key_hash(keys: pa.Array) -> np.ndarray:
    """64 bits of 16-byte keys."""
    data = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
    return mix(data[:, 0] ^ mix(data[:, 1]))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key binary, doc_id): one row per document row and distinct key of at least LEAST code points."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= LEAST))
    found = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.explode(keys).alias("key"))
    return found.select(F.unhex(F.md5("key")).alias("key"), "doc_id")


class LineIndex:
    """Exact postings, the counts of repeated keys, and the cuckoo filters over these keys."""

    def __init__(self, table: DataFrame, counts: DataFrame, filters: DataFrame, shards: int):
        self.table, self.counts, self.filters, self.shards = table, counts, filters, shards

    @classmethod
    def build(cls, table: DataFrame, unique: bool = False) -> LineIndex:
        """Index postings: reference counts, first holders, and filters of the keys that two documents or more hold.

        Rows that repeat a (key, doc_id) count once; ``unique`` says that there are none, or that only first holders matter.
        """
        table = table if unique else materialise(table.select("key", "doc_id").distinct())
        counts = materialise(cls.count(table))
        shards = max(1, -(-counts.count() // PER_SHARD))
        index = cls(table, counts, None, shards)
        index.filters = materialise(index._update(None, counts.select("key"), None))
        return index

    @staticmethod
    def count(table: DataFrame) -> DataFrame:
        """(key, holders, first_doc, last_doc) of the repeated keys."""
        return table.groupBy("key").agg(F.count("*").alias("holders"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _update(self, filters: DataFrame | None, added: DataFrame, removed: DataFrame | None) -> DataFrame:
        """Filters (shard, buckets, keys, table, full) after keys were added and removed; a shard holds about PER_SHARD keys.

        A full filter says so and stays as it was: then the index must be built anew.
        """
        changes = added.select("key", F.lit(1).alias("sign"))
        if removed is not None:
            changes = changes.unionByName(removed.select("key", F.lit(-1).alias("sign")))
        changes = changes.withColumn("shard", self._shard())
        schema = "shard int, buckets int, keys long, table binary, full boolean"
        if filters is None:
            filters = changes.sparkSession.createDataFrame([], schema)

        def apply(old: pa.Table, new: pa.Table) -> pa.Table:
            sign = new["sign"].to_numpy()
            h = key_hash(new["key"].combine_chunks()) if new.num_rows else np.zeros(0, U)
            plus, minus, n, full = h[sign > 0], h[sign < 0], 0, False
            shard = (old if old.num_rows else new)["shard"][0].as_py()
            if old.num_rows:
                row = old.slice(0, 1).to_pylist()[0]
                f, n = CuckooFilter(row["buckets"], row["table"]), row["keys"]
            else:
                f = CuckooFilter.for_keys(len(plus))
            f.remove(minus)
            while not full and not f.add(plus):
                full = n > 0
                f = f if full else CuckooFilter(2 * f.buckets)
            n += len(plus) - len(minus)
            return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([f.buckets], pa.int32()), "keys": pa.array([n], pa.int64()), "table": pa.array([f.table.tobytes()], pa.binary()), "full": pa.array([full])})

        return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(apply, schema)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with the lines of more documents; lines that a document of the index holds already are not counted again."""
        own = postings(docs, doc_id, text).distinct()
        new = materialise(own.join(self.table.select("key", "doc_id"), ["key", "doc_id"], "left_anti"))
        return self._changed(self.table.unionByName(new), new)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """The index without the documents whose ids are given (a null id: those without one): counts fall, and lines whose first holder goes pass to the next."""
        gone = materialise(ids.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id")).distinct())
        old = materialise(self.table.join(gone, "doc_id", "left_semi").select("key"))
        return self._changed(materialise(self.table.join(gone, "doc_id", "left_anti").select("key", "doc_id")), old)

    def _changed(self, table: DataFrame, change: DataFrame) -> LineIndex:
        """The index over ``table``, with the keys of ``change`` counted anew and all others as they were."""
        keys = materialise(change.select("key").distinct())
        before = self.counts.join(keys, "key", "left_semi")
        after = materialise(self.count(table.join(keys, "key", "left_semi")))
        counts = materialise(self.counts.join(keys, "key", "left_anti").unionByName(after))
        if counts.count() > self.shards * PER_SHARD * 1.5:
            return LineIndex.build(table, unique=True)
        plus, minus = (a.select("key").join(b.select("key"), "key", "left_anti") for a, b in ((after, before), (before, after)))
        filters = materialise(self._update(self.filters, plus, minus))
        if filters.where("full").limit(1).count():
            return LineIndex.build(table, unique=True)
        return LineIndex(table, counts, filters, self.shards)

    def maybe_repeated(self, lines: DataFrame) -> DataFrame:
        """The lines (key, doc_id) that the filters cannot rule out."""
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("table").alias("blob"), F.lit(None).cast("long").alias("doc_id"))
        rows = lines.select(self._shard().alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.col("key").alias("blob"), "doc_id")
        order = "shard", "salt", F.col("doc_id").asc_nulls_first()  # a filter comes before its lines

        @tidy
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for batch in batches:
                place = batch.column(0).to_numpy().astype(np.int64) * SALTS + batch.column(1).to_numpy()
                is_filter = np.asarray(batch.column(3).is_null())
                cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | is_filter[1:] | is_filter[:-1]])) if len(place) else np.zeros(0, np.int64)
                ok = np.zeros(len(place), bool)
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
                    if is_filter[a]:
                        table = batch.column(2)[a].as_py()
                        at, own = place[a], CuckooFilter(len(table) // (2 * CuckooFilter.SLOTS), table)
                    elif at == place[a]:  # a shard without a filter has no repeated key
                        ok[a:b] = own.has(key_hash(batch.column(2).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], ["key", "doc_id"]).filter(pa.array(ok))

        return rows.unionByName(filters).repartition("shard", "salt").sortWithinPartitions(*order).mapInArrow(probe, "key binary, doc_id long")

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys that each document loses, as a smaller doc_id holds them."""
        hits = self.maybe_repeated(lines).join(self.counts.select("key", "first_doc"), "key").where("first_doc < doc_id")
        return hits.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: LineIndex | None = None) -> DataFrame:
    """docs with __n_lines, __n_dropped and ``text`` without the lines whose key a smaller doc_id holds too.

    Lines are split at newlines (a null or empty text is one empty line). A key is the line without
    blanks at its ends and with A-Z lower-cased; shorter keys than LEAST code points never go. A
    null doc_id ranks last; rows that share a doc_id are one document, so none takes the other's
    lines. All other columns pass through, whatever their names; counts of an earlier run give way to the new ones. A hot line is aggregated before it is shuffled, and
    its rows in the exact join can be split. An empty table gives an empty one.
    """
    docs = docs.drop(*{"__n_lines", "__n_dropped"} - {doc_id, text})
    lines = materialise(postings(docs, doc_id, text))
    if index is None:
        index = LineIndex.build(lines, unique=True)
    own, keys = (name + "_" * max(map(len, docs.columns)) for name in ("id", "keys"))  # longer than all names of docs
    drops = index.dropped(lines).select(F.col("doc_id").alias(own), F.col("keys").alias(keys))
    joined = docs.join(drops, F.coalesce(docs[doc_id].cast("long"), F.lit(LAST)) == drops[own], "left").drop(own)
    schema = StructType([*docs.schema.fields, StructField("__n_lines", LongType()), StructField("__n_dropped", LongType())])
    at = docs.columns.index(text)

    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            texts, counts, dropped = [], [], []
            for value, keys in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (value or "").split("\n")
                kept = lines
                if keys:
                    gone = set(keys)
                    kept = [x for x in lines if len(k := plain_key(x)) < LEAST or md5(k.encode(), usedforsecurity=False).digest() not in gone]
                texts.append(value if len(kept) == len(lines) else "\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    return joined.mapInArrow(apply, schema)
