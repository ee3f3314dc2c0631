"""Collocations against counting every run of words in plain Python."""

import random
from collections import Counter
import re

import duckdb
import pytest

from dispensa.llm import collocations, entry


def plain(rows, least, most_words, percent, top):
    count, total = Counter(), Counter()
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most_words + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    often = {p: n for p, n in count.items() if n >= least and len(p[1]) > 1}
    out = {}
    for (lang, w), a in often.items():
        if any(x == lang and len(v) > len(w) and 100 * n >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), n in often.items()):
            continue
        l, r, score, _ = min(((count[lang, w[:k]], count[lang, w[k:]], 1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))), key=lambda c: (c[2], c[3]))
        out.setdefault(lang, []).append((" ".join(w), a, l, r, total[lang], score))
    done = set()
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        done |= {(lang, k + 1, *x) for k, x in enumerate(found[:top])}
    return done


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "And", "new", "york", "city", "é", "Éa", "x" * 50, "\x1f", "zz"]
    fixed = ["new york city hall", "of the", "a a a a a a"]
    rows = []
    for _ in range(n):
        t = " ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(fixed)]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "  ", " ;"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "fr", None, ""]), t))
    return rows + [("en", None), ("en", ""), ("fr", " .. \n"), ("de", "only once")]


@pytest.mark.parametrize("few", [collocations.FEW, 1])
@pytest.mark.parametrize("percent", [100, 60])
def test_equals_plain_counting(spark, few, percent):
    rows = corpus(percent)
    df = spark.createDataFrame([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, row int, id int")
    for least, most, top in ((5, 5, 2000), (2, 3, 7)):
        got = {tuple(r) for r in collocations.collocations(df, least, most, percent, top, few=few).collect()}
        want = plain(rows, least, most, percent, top)
        assert got == want and want
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("occurrences_")]


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**15, 10**15, [10**15], [10**15]), (3, 10**16, [3, 7], [5, 3])], "a long, n long, before array<long>, after array<long>")
    cut = [r.cut for r in big.selectExpr(f"{collocations.SCORE} AS cut").collect()]
    assert [(c.score, c.k) for c in cut] == [(1000, 0), (1000 * 3 * 10**16 // 21, 1)]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_joins_of_relations_move_no_rows(spark):
    rows = spark.range(1000).selectExpr("id % 10 AS row", "cast(id div 10 AS int) AS at", "id % 7 AS id")
    held = collocations.Relations(spark, 4)
    try:
        table = held.store(rows.repartition(4, "row"))
        with collocations.bucketed_joins(spark):
            plan = collocations.longer(table)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        held.drop()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_registered_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = set(con.sql(entry.SQL["op12_collocations"]).fetchall())
    out = entry.QUERIES["op12_collocations"](spark, d)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and dict(out.dtypes)["rank"] == "bigint"
    assert {tuple(r) for r in out.collect()} == want and len(want) > 50
