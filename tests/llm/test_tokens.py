import hashlib
import random

import pytest

import brute
from dispensa.llm import bpe, token_counts
from dispensa.llm.entry import _path

# Text fragments that the pattern treats in different ways.
PARTS = ["a", "s", "t", "re", "ll", "'", "’", " ", "  ", "\n", "\t", "1", "²", "é", "ß", " ", " ", "中", "ㅏ", "😀", "!", "-", "'s", "don't", "'S", "́", "\x1c", "\x85", "​", "<|endoftext|>", "the", " hello", " " * 30, "-" * 70, "ab" * 40]


def texts(seed, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)] + ["", None, "word " * 30_000, "x" * 20_000]


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(_path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_encode_equals_the_library_and_decodes_back(spark):
    data, lib = texts(1), library()
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    path = _path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(df, path), path).collect()
    for r in both:
        assert r.ids == lib.encode_ordinary(data[r.doc_id] or "")
        assert bytes(r.decoded) == (data[r.doc_id] or "").encode()
    for r in bpe.digests(df, path).collect():
        ids = lib.encode_ordinary(data[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == brute.sha(data[r.doc_id] or "")
    assert bpe.digests(df.limit(0), path).count() == 0


def test_vocabulary_is_a_minimal_perfect_hash():
    import numpy as np

    ranks = bpe.read_ranks(_path("byte_bpe_multi_50k.tiktoken"))
    v = bpe.Vocabulary(ranks)
    keys = [k for k in ranks if len(k) <= 24]
    assert v.n == len(keys) == len(set(v.ids.tolist()))
    buf = np.frombuffer(b"".join(keys), np.uint8)
    length = np.array([len(k) for k in keys])
    words = bpe.resolve.__globals__["key_words"](buf, np.cumsum(length) - length, length)
    h = bpe.resolve.__globals__["key_hash"](words, length)
    assert v.find(words, length, h).tolist() == [ranks[k] for k in keys]
    other = [w + np.uint64(1) for w in words]
    assert (v.find(other, length, bpe.resolve.__globals__["key_hash"](other, length)) < 0).mean() > 0.9


def test_memory_bound_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    ranks, lib = bpe.read_ranks(_path("byte_bpe_50k.tiktoken")), library()
    encoder = bpe.Encoder(ranks, bpe.Vocabulary(ranks))
    from dispensa.llm.kernels import text_bytes
    import pyarrow as pa

    for t in texts(4, 60):
        buf, offsets = text_bytes(pa.array([t]))
        assert encoder.encode(buf, offsets)[0].tolist() == lib.encode_ordinary(t or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    data = texts(2, 600)
    path = _path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(sp.encode(t or "")) for t in data]
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in data]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(data)], "doc_id long, text string, n_tokens int").repartition(3)
    got = token_counts.token_counts(df, path, 512).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len((t or "").encode()), want[i], want[i] > 512) for i, t in enumerate(data)}
