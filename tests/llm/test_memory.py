"""What the tasks of operators 5 and 10 hold at once."""

from __future__ import annotations

import tracemalloc
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from dispensa.llm import jaccard, packing
from dispensa.llm.entry import _path


class Tasks:
    """Takes a DataFrame's place and keeps the functions that would run in tasks."""

    def __init__(self):
        self.found = []

    def __getattr__(self, name):
        if name == "count":
            return lambda: jaccard.BROADCAST_IDS + 1
        return lambda *a: (self.found.append(a[0]) if name in ("mapInArrow", "applyInArrow") else None) or self


def texts(n: int, words: int = 300) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([" ".join(map(str, rng.integers(0, 10**6, words))) for _ in range(n)])], ["doc_id", "text"])


def watch(monkeypatch, size: int = 100_000) -> list[tuple[int, int]]:
    """(bytes of each call of shingle_sets, arrays of earlier calls still there)."""
    calls, refs, real = [], [], jaccard.shingle_sets

    def run(buf, offsets, width=5):
        calls.append((len(buf), sum(r() is not None for r in refs)))
        out = real(buf, offsets, width)
        refs.append(weakref.ref(out[0]))
        return out

    monkeypatch.setattr(jaccard, "LOCAL", size)
    monkeypatch.setattr(jaccard, "shingle_sets", run)
    return calls


def candidate_tasks(monkeypatch, n: int):
    monkeypatch.setattr(jaccard, "parts", lambda docs: n)
    tasks = Tasks()
    jaccard.candidates(tasks)
    return tasks.found


def test_a_slice_is_gone_before_the_next(monkeypatch):
    spread, _ = candidate_tasks(monkeypatch, 4)
    calls = watch(monkeypatch)
    assert sum(x.num_rows for x in spread(iter([texts(300)])))
    assert len(calls) > 3 and all(kept == 0 for _, kept in calls)


def test_sets_are_made_slice_by_slice(monkeypatch):
    calls, tasks, batch = watch(monkeypatch), Tasks(), texts(300)
    jaccard._sets(tasks, tasks, 5)
    out = pa.Table.from_batches(tasks.found[-1](iter([batch])))
    assert max(size for size, _ in calls) <= 100_000
    assert out["doc_id"].to_pylist() == list(range(300)) and all(len(x) == 296 * jaccard.VALUE for x in out["shingles"].to_pylist())


def test_a_bucket_holds_its_entries_once(monkeypatch):
    spread, meet = candidate_tasks(monkeypatch, 1)
    table = pa.Table.from_batches(list(spread(iter([texts(1500)])))).combine_chunks()
    entries = sum(len(a) // jaccard.SHORT for k, a in zip(table["kind"].to_pylist(), table["a"].to_pylist(), strict=True) if k == jaccard.PAIR)
    tracemalloc.start()
    out = meet(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows >= 1500 and peak < 80 * entries


def test_packing_lets_go_of_a_batch_before_the_next(monkeypatch):
    """The task's own names must not keep a batch of texts while the next one is read."""
    refs, kept, tasks = [], [], Tasks()
    encoder = SimpleNamespace(encode=lambda buf, offsets: (np.zeros(offsets[-1], np.int64), offsets))
    monkeypatch.setattr(packing, "Library", lambda *a: encoder)
    monkeypatch.setattr(packing, "first_tier", lambda *a: 1)
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), select=lambda *a: tasks)
    monkeypatch.setattr(packing.F, "col", lambda name: tasks)
    packing.pieces(docs, _path("byte_bpe_50k.json"), 2048, 0)

    def batches():
        for _ in range(3):
            kept.append(sum(r() is not None for r in refs))
            batch = texts(20)
            refs.append(weakref.ref(batch))
            yield batch
            del batch

    out = pa.Table.from_batches(tasks.found[-1](batches()))
    assert sorted(set(out["doc_id"].to_pylist())) == list(range(20)) and kept == [0, 0, 0]


def test_packing_gets_batches_of_few_bytes(spark, monkeypatch):
    def sizes(docs, *a):
        def run(batches):
            for x in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x.nbytes], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(packing, "pieces", sizes)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('some text ', 800) as text")  # 32 MB in one task
    monkeypatch.setattr(packing, "best_fit", lambda lengths, *a: np.arange(len(lengths)))
    got = [r["doc_id"] for r in packing.pack(docs, _path("byte_bpe_50k.json"), 1 << 30).collect()]
    assert sum(got) > 32_000_000 and max(got) < 8 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
