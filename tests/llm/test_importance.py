"""Importance resampling against a plain version, and its parts against their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from dispensa.llm import entry, importance

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def crcs(text, most=2):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=25, least=20, buckets=10_000, most=2):
    own = [[c % buckets for c in crcs(t, most)] for _, t in rows]
    s, t = Counter(b for x in own for b in x), Counter(c % buckets for x in target for c in crcs(x, most))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for (d, text), x in zip(rows, own, strict=True):
        w = math.floor(sum(gain[b] for b in x) / len(x)) if x else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_equals_the_plain_version(spark):
    rng = random.Random(5)
    vocabulary = ["The", "of", "été", "ÉTÉ", "a1", "x-y", "can't", "w" * 400, "漢字", "\x7f", "q\x00r"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ". ", "_"]) for _ in range(n))
    rows = [(k, text(rng.randint(0, 80))) for k in range(150)] + [(900, None), (901, ""), (None, text(40)), (902, "---"), (903, text(9000))]
    target = [text(5), None, "", "benchmark words the OF"]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, score int, bucket string").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in importance.resample(docs, bench).collect()), key=str)
    assert got == plain(rows, target)
    few = sorted((tuple(r) for r in importance.resample(docs, bench, percent=50, least_words=3, buckets=11, most=3).collect()), key=str)
    assert few == plain(rows, target, 50, 3, 11, 3)


def test_repeated_rows_have_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)] * 8, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resample(docs, docs).collect() if r["rank"])
    assert ranks == [1, 2]


def test_pieces_of_long_texts_give_the_same_windows():
    text = "Aé b2 " * 3000 + "z" * 3000 + " end. " + "tail " * 50
    split = importance.splitter()
    for size in (7, 100, 1 << 15):
        n, found = importance.windows(text, split, size=size)
        assert n == len(words(text)) and sorted(found) == sorted(crcs(text))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert sorted((tuple(r) for r in importance.resample(some, none).collect()), key=str) == plain([(1, "one two"), (2, None)], [])


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    out = entry.QUERIES["op11_importance_resampling"](spark, d)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows, target)
