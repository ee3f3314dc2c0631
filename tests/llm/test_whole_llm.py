"""Operators do the whole job at every size, on small inputs."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

import brute
from dispensa.llm import batches, jaccard, packing, quality, state
from dispensa.llm.entry import _path


def frame(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


def test_jaccard_buckets_grow_with_the_corpus_and_heavy_subsets_stay_in_batches(spark, monkeypatch):
    rows = brute.corpus(5, 160)
    rows += [(10_000 + k, rows[3][1] if k % 2 else f"{rows[3][1]} tail{k}", "en", "s", 1) for k in range(12)]
    docs = frame(spark, rows)
    monkeypatch.setattr(batches, "PART_BYTES", 2048)
    assert batches.parts(docs) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(jaccard, "HEAVY", 2)
    found = jaccard.candidates(docs.select("doc_id", "text"))
    assert found.where(f"kind = {jaccard.HELD}").count() > 0
    heavy = {(r.x, r.y): r.asks for r in jaccard._met(found).collect()}
    monkeypatch.setattr(jaccard, "HEAVY", 1 << 40)
    plain = {(r.x, r.y): r.asks for r in jaccard._met(jaccard.candidates(docs.select("doc_id", "text"))).collect()}
    assert heavy.keys() == plain.keys() and all(heavy[k] for k, asks in plain.items() if asks)
    monkeypatch.setattr(jaccard, "HEAVY", 2)
    got = jaccard.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.op10(rows)


def test_jaccard_makes_a_pair_once_however_many_buckets_find_it(spark, monkeypatch):
    """Near copies share subsets in every bucket; rows made follow the documents, batches and buckets, not what pairs share."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words, *rng.choices(words, k=3)]), "en", "s", 1) for i in range(40)]
    docs = frame(spark, rows).select("doc_id", "text")
    monkeypatch.setattr(batches, "PART_BYTES", 2048)
    n = batches.parts(docs)
    found = state.materialise(jaccard.candidates(docs))
    assert n > 10 and found.count() <= len(rows) + 3 * (n + 1)  # three batches
    assert {(r.x, r.y) for r in jaccard._met(found).collect()} >= {(0, k) for k in range(1, 40)}


def test_jaccard_buckets_may_have_nothing_to_tell(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60)), "en", "s", 1), (2, "b c d", "en", "s", 1)]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.op10(rows)


def test_jaccard_compares_groups_in_blocks(spark, monkeypatch):
    """Groups of passages that are shared without similarity, in blocks of two sets."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choices(words, k=12)) for _ in range(4)]
    rows = [(i, " ".join(rng.sample(passages, 2) + rng.choices(words, k=rng.randint(0, 4))), "en", "s", 1) for i in range(150)]
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    compared = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *a: compared.append(across(*a)) or compared[0])
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.op10(rows)
    assert compared[0].count() > 0


def test_jaccard_sets_that_lack_segments_meet_all_that_are_similar(spark):
    rows = brute.corpus(6, 100)
    docs = frame(spark, rows).select("doc_id", "text")
    sets = {r[0]: brute.shingles(r[1]) for r in rows}
    lacking = [d for d in sets if d % 2]
    got = {(r.x, r.y) for r in jaccard._alone(docs, spark.createDataFrame([(d,) for d in lacking], "doc_id long"), 5).collect()}
    want = {(min(a, b), max(a, b)) for a in lacking for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_folded_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (5, 300, 6000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        x, y = jaccard.folded([jaccard.sketch(a), jaccard.sketch(b)])
        assert np.bitwise_count(x ^ y).sum() <= 2 * (n // 10)


def test_full_pieces_have_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 8)
    rows = [(k, f"word{k} " * 400, "en", "s", 1) for k in range(8)] + [(100, "a b", "en", "s", 1)]
    got = packing.pack(spark.createDataFrame(rows, brute.SCHEMA), _path("byte_bpe_50k.json"), 64, weights=packing.WEIGHTS).collect()
    full = [r for r in got if r.length == 64]
    assert len(full) > 40
    assert len({r.sequence_id for r in full}) == len(full)
    assert len({r.sequence_id >> 32 for r in full}) > 1
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 64
    assert min(packing.WEIGHTS) > 0


def test_fences_are_broadcast_only_if_the_broadcast_rows_are_few(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "some words " * 40, "en", f"host{k}", 1) for k in range(10)], brute.SCHEMA)
    hinted = lambda: "strategy=broadcast" in quality.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert hinted()
    monkeypatch.setattr(quality, "GROUPS_BROADCAST", 3)
    assert not hinted()
