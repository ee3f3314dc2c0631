"""SimHash groups against all pairs, and the parts of the index against their definitions."""

import random

import pytest
import xxhash

from dispensa.llm import entry, simhash


def plain(text, width=4):
    words = [w for w in (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, most=4):
    """{row: least id} by comparing all pairs of (id, fingerprint)."""
    top = list(range(len(prints)))

    def find(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for i, (a, f) in enumerate(prints):
        for j in range(i):
            b, g = prints[j]
            if (f ^ g).bit_count() <= most or a == b:
                top[find(i)] = find(j)
    least = {}
    for k, (a, _) in enumerate(prints):
        least[find(k)] = min(least.get(find(k), a), a)
    return [least[find(k)] for k in range(len(prints))]


def held(rows, out, last=1 << 62):
    prints = [(last if d is None else d, plain(t)) for d, t in rows]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(prints, grouped(prints), strict=True))
    got = sorted((last if r.doc_id is None else r.doc_id, r.fingerprint, last if r.component_id is None else r.component_id) for r in out.collect())
    assert got == want
    return want


def corpus(rng, n):
    words = [f"w{k}" for k in range(60)] + ["Été", "ÀB", "x" * 300]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(n // 4)]
    rows = []
    for k in range(n):
        w = rng.choice(base).split(" ")
        if k % 3:
            w[rng.randrange(len(w))] = "Changed"
        rows.append((k * 7 % 1000003, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(5_000_000, None), (5_000_001, ""), (5_000_002, " \n"), (None, "a b"), (None, "c d e f g h"), (5_000_003, "a b"), (5_000_003, base[0]), (5_000_003, base[0])]


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_groups_equal_all_pairs(spark, hot):
    rows = corpus(random.Random(hot), 240)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, first long")
    want = held(rows, simhash.simhash_groups(df, hot=hot))
    assert len({c for _, _, c in want}) < len(want) - 50  # there are groups


def test_links_of_crowded_values_connect_alike(spark):
    """Fingerprints around one centre: pairwise links below ``hot``, midpoints above it."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    some = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(sorted(some))]
    classes = spark.createDataFrame(signed, "fp long, first long")
    want = grouped([(k, f) for k, f in enumerate(sorted(some))])
    for hot in (4096, 5):
        found = simhash.links(classes, hot=hot).collect()
        top = {k: k for _, k in signed}
        for _ in range(len(top)):
            for x, y in found:
                top[x] = top[y] = min(top[x], top[y])
        assert [top[k] for k in range(len(want))] == want


def test_layout_finds_every_pair_within_reach():
    rng = random.Random(1)
    for n in (2, 1000, 40_000, 200_000, 10**7, 10**10):
        segments = simhash.layout(n)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any((differ >> low & (1 << bits) - 1).bit_count() <= radius for low, bits, radius in segments)


def test_long_texts_in_pieces_are_the_same():
    text = " ".join(f"word{k % 977}" for k in range(5000)) + " " + "y" * 5000
    whole = [h for part in simhash.shingle_hashes(text) for h in part]
    assert whole == [h for part in simhash.shingle_hashes(text, size=100) for h in part]
    assert len(whole) == 5001 - 3


def test_empty_table_and_registered_query(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    held(rows, entry.QUERIES["op13_simhash_groups"](spark, d))
