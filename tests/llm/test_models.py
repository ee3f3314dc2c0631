import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import brute
from dispensa.llm import ann, packing, quality, toxicity
from dispensa.llm.entry import _path
from dispensa.llm.kernels import text_bytes


def test_quality_base_equals_brute_force(spark):
    rows = brute.corpus(1) + [(9001, "a b c " * 40, "en", "s", 1), (9002, "x\n x\nx\n\n \n", "en", "s", 1), (9003, "# $x | <y>\ta b c d a b c", "en", None, 1)]
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    got = quality.judge(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {r[0]: brute.op7_base(r[1]) for r in rows}
    assert not any(r.kept and r.base_failed for r in got)


def test_fences_reject_junk_and_keep_clean(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(900)]
    clean = [(i, " ".join(rng.choices(words, k=rng.randint(80, 200))), "en", "a" if i % 2 else "b", 1) for i in range(600)]
    junk = [(10_000 + i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in rng.choices(words, k=120)), "en", "a", 1) for i in range(12)]
    docs = spark.createDataFrame(clean + junk, brute.SCHEMA)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == {r[0] for r in clean}
    assert quality.keep_good(docs).count() == len(clean)
    assert quality.judge(docs.limit(0)).count() == 0


def exact_kept(rows):
    """The verdicts with exact quantiles in the place of sketches."""
    base = {}
    for d, text, lang, source, *_ in rows:
        n, chars, symbols, dup, repeat, failed = brute.op7_base(text)
        lines = sum(1 for x in (text or "").split("\n") if brute.WORD.search(x))
        base[d] = (lang, source, failed, {"mean_word": chars / n if n else 0, "symbol_ratio": symbols / n if n else 0, "dup_line_ratio": dup / lines if lines else 0, "repeat_ratio": repeat / n if n else 0})

    def fence(r, inside, parent):
        both, some = quality.RATIOS[r]
        v = sorted(x[3][r] for x in base.values() if not x[2] and inside(x) and (x[3][r] > 0 or not some))
        if not v:
            return parent
        low, high = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        own = (low - quality.TIMES * (high - low) if both else -math.inf, high + quality.TIMES * (high - low))
        if parent is None:
            return own
        return tuple(a if a == b else a + (b - a) * quality.PRIOR / (len(v) + quality.PRIOR) for a, b in zip(own, parent))

    out = set()
    for d, x in base.items():
        ok = not x[2]
        for r in quality.RATIOS:
            f = fence(r, lambda y: y[:2] == x[:2], fence(r, lambda y: y[0] == x[0], fence(r, lambda y: True, None)))
            ok = ok and (f is None or f[0] <= x[3][r] <= f[1])
        if ok:
            out.add(d)
    return out


def test_kept_equals_exact_quantiles_over_languages_and_sources(spark):
    """Groups are small enough for sketches to hold every value; a null language and source, clashing names and a long text are among them."""
    rng = random.Random(2)
    words = {k: ["".join(rng.choices("abcdefgh", k=rng.randint(2, n))) for _ in range(500)] for k, n in (("en", 6), ("de", 12), (None, 9))}
    rows = []
    for i in range(330):
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(rng.choices(words[lang], k=rng.randint(40, 160)))
        if i % 7 == 0:
            text = "\n".join([text, "one more line", "one more line"])
        if i % 11 == 0:
            text = " ".join(w + "#" * rng.randint(0, 9) for w in text.split(" "))
        if i % 13 == 0:
            text += " and so it goes on" * rng.randint(1, 9)
        rows.append((i, text, lang, rng.choice(["a", "b", None]), 1))
    rows += [(900, " ".join(rng.choices(words["en"], k=20_000)), "en", "a", 1), (901, None, None, None, None), (902, "", "en", "new", 0)]
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], brute.SCHEMA + ", f string, level int").repartition(3)
    got = quality.judge(docs).collect()
    want = exact_kept(rows)
    assert {r.doc_id for r in got if r.kept} == want
    assert len(got) == len(rows) and 100 < len(want) < sum(not r.base_failed for r in got)


def test_forest_recall_and_contract(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    bad = [(5000, None, 0), (5020, [0.0] * 64, 0), (5040, [float("nan")] * 64, 0), (5060, [None] * 64, 0), (5080, [], 0), (None, [1.0] * 64, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3)
    got = ann.search(df, ann.F.col("vec_id") % 20 == 0, 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 20))
    double, hits = v.astype(np.float64), 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        exact = double @ double[q]
        exact[q] = -9
        hits += len({r[1] for r in rows} & set(np.argsort(-exact)[:20].tolist()))
        assert all(abs(s - exact[i]) < 1e-12 for _, i, s in rows)
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
    assert hits / (20 * len(found)) >= 0.9
    few = ann.search(df.where("vec_id < 5"), ann.F.col("vec_id") == 0, 20)
    assert few.count() == 4
    assert ann.search(df.limit(0), ann.F.col("vec_id") == 0, 20).count() == 0


def plain_neighbours(rows, asked, k=20):
    table = [(i, np.array(x)) for i, x in rows]
    out = set()
    for q in asked:
        own = next(x for i, x in table if i == q)
        best = sorted((-float((x * own).cumsum()[-1]), i) for i, x in table if i != q and len(x) == len(own))[:k]
        out |= {(q, p + 1, i, -s) for p, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("layout", ["other length without query", "queries in one slice", "no query", "one query", "length beyond the sample"])
def test_forest_slices_and_lengths_without_queries(spark, layout, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(ann, "SLICE", 64)
    monkeypatch.setattr(ann, "MEET", 0)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rng.standard_normal((300, 6)))]
    asks = {"queries in one slice": lambda i: i < 15, "no query": lambda i: i < 0, "one query": lambda i: i == 299}.get(layout, lambda i: i % 20 == 0)
    if layout == "other length without query":
        rows.append((1001, [1.0, 2.0, 3.0]))
    if layout == "length beyond the sample":
        monkeypatch.setattr(ann, "SAMPLE", 1)
        rows += [(2000 + i, [float(i), 1.0, -2.0]) for i in range(0, 200, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = [i for i, _ in rows if asks(i)]
    got = {tuple(r) for r in ann.search(df, ann.F.col("vec_id").isin([*asked, -1]), 20).collect()}
    want = plain_neighbours(rows, asked)
    assert {r[:2] for r in got} == {r[:2] for r in want} or layout == "length beyond the sample"
    pairs = lambda x: {(r[0], r[2]) for r in x}
    assert len(pairs(got) & pairs(want)) >= 0.8 * len(want) and bool(got) == bool(want)


def test_full_leaves_are_dealt_to_several_tasks(spark, monkeypatch):
    """Clusters whose leaves hold more than ``block`` vectors; every query gets its number of answers."""
    monkeypatch.setattr(ann, "MEET", 0)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((4, 12))
    rows = [(i, [float(x) for x in centre[i % 4] + 0.05 * rng.standard_normal(12)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = ann.F.col("vec_id") % 20 == 0
    want = {r[:1] + r[2:3] for r in plain_neighbours(rows, range(0, 800, 20))}
    for block in (ann.BLOCK, 16):
        got = {(r.query_id, r.vec_id) for r in ann.search(df, ask, 20, block=block).collect()}
        assert len(got) == 800 and len(got & want) >= 0.9 * 800


def test_prefixes_and_levels():
    """What a level admits is what the definition says, leaf by leaf."""
    rng = np.random.default_rng(10)
    forest = ann.Forest(9, 4, 2.0)
    v, q = rng.standard_normal((300, 9)) * 0.3, rng.standard_normal((5, 9))
    leaf = forest.stored(v)
    for level in (0.5, 1.3, 2.2):
        row, cell = forest.visited(q, level)
        for k in range(5):
            taken = set(cell[row == k].tolist())
            met = [any(c in taken for c in x) for x in leaf.tolist()]
            want = [bool(forest.level(q[k : k + 1], x[None])[0] >= level) for x in v]
            assert met == want
    for a in range(16):
        for b in range(16):
            x, y = f"{a:04b}", f"{b:04b}"
            same = next((k for k in range(4) if x[k] != y[k]), 4)
            assert forest.common(np.array([a]), np.array([b]))[0] == same


def test_forest_ties_norms_and_lengths(spark):
    """Repeated vectors, components of size 1e6, norms that differ much, and vectors of another length; all against brute force."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 16)) * rng.choice([1.0, 30.0, 1e6], (400, 1))
    v[100:200] = v[7]
    v[300:310] = -v[7]
    rows = [(i, [float(x) for x in r], "p", 1) for i, r in enumerate(v)] + [(7, [float(x) for x in v[7]], "q", 2)]
    rows += [(1000 + 20 * i, [1.0, float(i)], "p", 3) for i in range(5)] + [(2000, [0.5] * 3, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, c string, rank int").repartition(3)
    got = {}
    for r in ann.search(df, (ann.F.col("vec_id") % 20 == 0) | (ann.F.col("vec_id") == 7), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    short = {i: [1.0, float((i - 1000) // 20)] for i in range(1000, 1100, 20)}
    asked = [i for i in range(400) if i % 20 == 0 or i == 7]
    assert set(got) == {*asked, *short}  # 2000 has no candidate of its length
    table = [(r[0], np.array(r[1])) for r in rows]
    for q in [*asked, *short]:
        own = next(x for i, x in table if i == q)
        want = sorted((-float((x * own).cumsum()[-1]), i) for i, x in table if i != q and len(x) == len(own))[:20]
        times = 2 if q == 7 else 1  # a repeated query row is answered for each
        assert sorted(got[q]) == sorted([(p + 1, i, -s) for p, (s, i) in enumerate(want)] * times)


def test_toxicity_learns_on_held_out_rows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = rng.choices(words, k=60)
        if toxic:
            for k in range(0, 60, 12):
                w[k] = rng.choice(["vile,", "Awful", "nasty."])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(7001, None, None, None, None), (7002, "", "en", "s", 0), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(3)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    out = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def plain_ftrl(rows):
    """Weights by FTRL-proximal over dictionaries: rows of (hash order, text, label)."""
    data = []
    for _, text, label in sorted(rows):
        numbers, _ = toxicity.features(*text_bytes(pa.array([text])))
        counts = {}
        for i in numbers.tolist():
            counts[i] = counts.get(i, 0) + 1
        data.append(({i: math.log1p(c) for i, c in sorted(counts.items())} | {toxicity.BIAS: 1.0}, label))
    texts_with = {}
    for x, _ in data:
        for i in x:
            texts_with[i] = texts_with.get(i, 0) + 1
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    ones = sum(y for _, y in data)
    heavy = min(10.0, max(1.0, (len(data) - ones) / max(1, ones)))
    for _ in range(toxicity.EPOCHS):
        for x, y in data:
            x = {i: v for i, v in x.items() if i == toxicity.BIAS or texts_with[i] >= toxicity.LEAST}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (heavy if y else 1.0) * (p - y) * v
                root = math.sqrt(n.get(i, 0))
                n[i] = n.get(i, 0) + g * g
                z[i] = z.get(i, 0) + g - (math.sqrt(n[i]) - root) / toxicity.ALPHA * w[i]
    return {i: weight(i) for i in n}


def test_toxicity_equals_a_plain_ftrl_and_edge_cases(spark, monkeypatch):
    """Scores against the brute-force model; repeated rows, null, empty and long texts; the bounds on the sample; no labels, no rows."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=30) + (["Vile!", "nasty things"] if i % 4 == 0 else [])), "en", "s", 1, "x", 0) for i in range(240)]
    rows += [(300, None, None, None, None, None, None), (301, "", "en", "s", 0, "x", 0), (302, "vile " * 30_000, "en", "s", 0, "x", 0), (4, rows[4][1], "en", "s", 1, "x", 0)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, brute.SCHEMA + ", h string, label int").repartition(3)
    order = {r.id: r.h for r in docs.select(toxicity.F.col("doc_id").alias("id"), toxicity.F.xxhash64("doc_id").alias("h")).collect()}
    learned = [r for r in rows if r[0] < 240 and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    w = plain_ftrl([((order[r[0]], r[0]), r[1], int(r[0] % 4 == 0)) for r in learned])
    got = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got:
        numbers = toxicity.features(*text_bytes(pa.array([text_of[r.doc_id]])))[0]
        i, x = toxicity.vector(numbers)
        assert abs(r.score - 1 / (1 + math.exp(-sum(w.get(a, 0.0) * b for a, b in zip(i.tolist(), x.tolist()))))) < 1e-9
    assert len({r.score for r in got if not text_of[r.doc_id]}) == 1
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    known = labels.select(toxicity.F.col("doc_id").alias("id"), toxicity.F.col("toxic").alias("label"))
    whole = toxicity.fit(docs, known)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    assert whole and toxicity.fit(docs, known) != whole


def test_ftrl_weights_are_sparse():
    model = toxicity.Ftrl()
    for k in range(4000):
        model.learn(np.array([1 + k % 2, 5 + k // 2 % 50, 0]), np.ones(3), k % 2, 1.0)
    w = model.weights(np.arange(60))
    assert w[1] <= 0 < w[2] and (w[5:55] == 0).mean() > 0.5


def test_best_fit_meets_every_capacity():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 2000, 500))[::-1]
    for rule in ("norm", "dot"):
        bins = packing.best_fit(lengths, 2048, 4, 2_500_000, (1.0, 0.5, 0.5), rule)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert own.sum() <= 2048 and len(own) <= 4 and ((own.astype(float) ** 2).sum() <= 2_500_000 or len(own) == 1)
    plain = packing.best_fit(lengths, 2048, 2048, 2048.0**2)
    assert plain.max() + 1 <= np.ceil(lengths.sum() / 2048) * 1.25


def test_packing_contract(spark):
    from tokenizers import Tokenizer

    rows = brute.corpus(2, 80) + [(9001, "tokens " * 5000, "en", "s", 1), (9002, "a<|endoftext|>b", "en", "s", 1)]
    got = packing.pack(spark.createDataFrame(rows, brute.SCHEMA), _path("byte_bpe_50k.json"), 2048).collect()
    tok = Tokenizer.from_file(_path("byte_bpe_50k.json"))
    total = 0
    for d, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert all(r.length == 2048 for r in own[1:])
        total += len(ids)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 2
