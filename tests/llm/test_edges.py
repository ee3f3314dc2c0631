"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns; and packing against a plain model."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from dispensa.llm import bpe, packing, token_counts
from dispensa.llm.entry import _path

LONG = "word " * 100
ROWS = [(None, LONG), (None, None), (4, LONG), (4, LONG), (5, None), (6, ""), (7, "é" * 9000 + " tail " * 3000)]


def frame(spark, names):
    rows = [(d, x, "en", "s", None if x is None else len(x), *([7] * len(names))) for d, x in ROWS]
    return spark.createDataFrame(rows, ", ".join([brute.SCHEMA, *(f"{n} long" for n in names)])).repartition(3)


def key(rows):
    return sorted(rows, key=repr)


def test_tokens_of_edge_cases(spark):
    docs, path = frame(spark, ["n_tokens", "n_bytes", "ids", "part"]), _path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    n = {x: len(tok.encode(x or "", add_special_tokens=False).ids) for _, x in ROWS}
    got = token_counts.token_counts(docs, path, 512).collect()
    assert key((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == key((d, len((x or "").encode()), n[x], n[x] > 512) for d, x in ROWS)
    got = bpe.digests(docs, _path("byte_bpe_50k.tiktoken")).collect()
    assert key((r.doc_id, r.decoded_sha256) for r in got) == key((d, hashlib.sha256((x or "").encode()).hexdigest()) for d, x in ROWS)
    assert token_counts.token_counts(docs.limit(0), path, 512).count() == 0


def test_packing_of_edge_cases(spark):
    docs, path = frame(spark, ["length", "piece", "bin_group", "sequence_id"]), _path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 2048, weights=packing.WEIGHTS).collect()
    want = {}
    for d, x in ROWS:
        want[d] = want.get(d, 0) + len(tok.encode(x or "", add_special_tokens=False).ids) + 1
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want
    used = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, p, _) in zip(used, used[1:]):
        assert p == (o + n if s == t else 0)
    assert packing.pack(docs.limit(0), path).count() == 0


def plain_best_fit(lengths, capacity, docs, cost, weights, rule):
    bins, out = [], []
    for n in lengths:
        item = (n / capacity, 1 / docs, n * n / cost)
        best = None
        for b, free in enumerate(bins):
            if all(f >= x - 1e-12 for f, x in zip(free, item)):
                rest = sum(w * (f - x) ** 2 for w, f, x in zip(weights, free, item)) if rule == "norm" else -sum(w * f * x for w, f, x in zip(weights, free, item))
                if best is None or rest < best[0] - 1e-15:
                    best = (rest, b)
        b = best[1] if best else len(bins)
        if best is None:
            bins.append((1.0, 1.0, 1.0))
        bins[b] = tuple(f - x for f, x in zip(bins[b], item))
        out.append(b)
    return out


def test_best_fit_equals_a_plain_model_and_opens_no_more_bins_than_scalar_best_fit():
    rng = np.random.default_rng(2)
    for seed in range(6):
        lengths = np.sort(rng.integers(1, 1200, 300))[::-1]
        for rule in ("norm", "dot"):
            got = packing.best_fit(lengths, 2048, 5, 2_500_000.0, packing.WEIGHTS, rule)
            assert got.tolist() == plain_best_fit(lengths.tolist(), 2048, 5, 2_500_000.0, packing.WEIGHTS, rule)
        many = np.sort(np.minimum(2047, rng.lognormal(5.5, 1.0, 8000).astype(int) + 2))[::-1]
        bins = [packing.best_fit(many, 2048, 2048, 2048.0**2, w).max() + 1 for w in (packing.WEIGHTS, (1.0, 0.0, 0.0))]
        assert bins[0] <= bins[1] and bins[0] <= -(-int(many.sum()) // 2048) + 1


def test_pipeline_of_edge_cases_and_of_an_empty_table(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(3, 8))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(30)]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)] + [(None, texts[3], None, None, None), (None, " ".join(rng.choices(words, k=90)), "en", None, 1), (5, texts[5], "en", "s", 1), (77, None, "en", "s", None), (78, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    for name, part in (("some", docs), ("none", docs.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    # The line of the null id that document 3 has too goes before links are sought, so the null id is linked with nothing and stays.
    assert {r.doc_id for r in got} == {*range(30), None}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_token_counts_keep_columns_of_any_name(spark):
    """A kept column called like a count gives way to it; any other stays."""
    docs, path = frame(spark, ["n_tokens", "__text", "c1"]), _path("byte_bpe_50k.json")
    plain = token_counts.token_counts(docs, path)
    got = token_counts.token_counts(docs, path, keep=("__text", "doc_id", "n_tokens", "c1"))
    assert got.columns == ["__text", "doc_id", "c1", "n_bytes", "n_tokens", "over_limit"]
    assert key(map(tuple, got.select(plain.columns).collect())) == key(map(tuple, plain.collect()))
    assert {(r["__text"], r["c1"]) for r in got.collect()} == {(7, 7)}


def test_line_dedup_keeps_columns_of_any_name(spark):
    from dispensa.llm.line_dedup import dedup_lines

    rows = [(1, "one long line\nx", 7, ["k"], 9), (2, "y\nONE long line ", 8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __keys array<string>, __n_lines int")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "__id", "__keys", "__n_lines", "__n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "one long line\nx", 7, ["k"], 2, 0), (2, "y", 8, None, 2, 1)]
