import pytest

import brute
from dispensa.llm import jaccard, line_dedup, substring_dedup, suffix_dedup

SEEDS = [1, 2]


def frame(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", SEEDS)
def test_suffix_dedup_equals_brute_force(spark, seed, monkeypatch):
    rows = brute.corpus(seed)
    if seed == 2:  # every shared anchor counts as hot
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = suffix_dedup.dedup_bytes(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.op1(rows)
    by_id = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        data = by_id[r.doc_id]
        assert sum(s.after - s.first for s in r.removed) == r.n_removed
        assert len(data) - len(r.kept) == r.n_removed


@pytest.mark.parametrize("seed", SEEDS)
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = brute.corpus(seed)
    got = substring_dedup.dedup_windows(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.op6(rows)


@pytest.mark.parametrize("seed", SEEDS)
def test_line_dedup_equals_brute_force(spark, seed):
    rows = brute.corpus(seed)
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r["__n_lines"], r["__n_dropped"], brute.sha(r.text or "")) for r in got} == brute.op4(rows)


@pytest.mark.parametrize("small", [7, 2])
def test_jaccard_equals_brute_force(spark, small, monkeypatch):
    rows = brute.corpus(5, 160)
    plain = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda docs, width=5, least=small: plain(docs, width, least))
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    want = brute.op10(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows) - 5


def test_line_index_is_reversible(spark):
    rows = brute.corpus(3, 60)
    docs = frame(spark, rows)
    half, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex.build(line_dedup.postings(half)).insert(rest)
    got = line_dedup.dedup_lines(docs, index=index).collect()
    assert {r.doc_id: r["__n_dropped"] for r in got} == {k: v[1] for k, v in brute.op4(rows).items()}
    index = index.delete(half.select("doc_id"))
    got = line_dedup.dedup_lines(rest, index=index).collect()
    assert {r.doc_id: r["__n_dropped"] for r in got} == {k: v[1] for k, v in brute.op4([r for r in rows if r[0] % 2]).items()}


def test_line_index_counts_and_null_ids(spark, monkeypatch):
    """Reference counts are exact under repeated insertions; a null id can be deleted; full filters build the index anew."""
    line = "a line that is long enough"
    rows = [(1, line, "en", "s", 1), (2, f"{line}\n{line.upper()}", "en", "s", 1), (None, line, "en", "s", 1)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    held = lambda x: [(r.holders, r.first_doc) for r in x.counts.collect()]
    index = line_dedup.LineIndex.build(line_dedup.postings(docs.unionByName(docs)))
    assert held(index) == [(3, 1)]
    assert held(index.insert(docs)) == [(3, 1)]
    index = index.delete(docs.where("doc_id is null").select("doc_id"))
    assert held(index) == [(2, 1)]
    index = index.delete(docs.where("doc_id = 1").select("doc_id"))
    assert held(index) == []
    more = spark.createDataFrame([(k, "\n".join(f"line number {i} of many" for i in range(90)), "en", "s", 1) for k in (5, 6)], brute.SCHEMA)
    index = index.insert(more).insert(docs)
    assert sorted(held(index)) == [(2, 5)] * 90 + [(3, 1)]
    rebuilt = []
    plain = line_dedup.LineIndex.build.__func__
    monkeypatch.setattr(line_dedup.LineIndex, "build", classmethod(lambda cls, *a, **k: rebuilt.append(1) or plain(cls, *a, **k)))
    again = spark.createDataFrame([(k, "\n".join(f"another line {i} of many" for i in range(60)), "en", "s", 1) for k in (7, 8)], brute.SCHEMA)
    assert len(held(index.insert(again))) == 151 and rebuilt == [1]


def test_cuckoo_filter():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 1 << 63, 30_000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.for_keys(len(keys))
    assert f.add(keys) and f.has(keys).all()
    f.remove(keys[:10_000])
    assert f.has(keys[10_000:]).all() and f.has(keys[:10_000]).mean() < 0.01


def test_edge_cases(spark):
    """Empty tables, only nulls, null ids, repeated rows, and clashing extra columns."""
    schema = brute.SCHEMA + ", part int, key string, bucket int"
    long = "word " * 100
    rows = [(None, long, None, None, None, 1, "k", 2), (None, None, None, None, None, None, None, None), (4, long, "en", "s", 1, 1, "k", 2), (4, long, "en", "s", 1, 1, "k", 2), (9, long, "en", "s", 1, 1, "k", 2)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 99, r.n_removed) for r in suffix_dedup.dedup_bytes(docs).collect())
    assert got == [(4, 0), (4, 0), (9, 500), (99, 0), (99, 500)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.dedup_windows(docs).collect()}
    assert got[9, 100] == 100 and got[None, 100] == 100 and got[None, 0] == 0
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()} == {(4, 4), (9, 4), (None, 4)}
    assert line_dedup.dedup_lines(docs).count() == 5
    none = docs.limit(0)
    for f in (suffix_dedup.dedup_bytes, substring_dedup.dedup_windows, jaccard.near_duplicates, line_dedup.dedup_lines):
        assert f(none).count() == 0
