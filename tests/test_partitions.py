"""Writes that replace only what they touch, nested lists with a bound, joins by grams, and documents of mixed types."""

import os
import random

from pyspark.sql import functions as F

from dispensa.functions import values
from dispensa.operators import aggregates, links
from dispensa.sources import tables, writers


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upsert_leaves_the_files_of_other_partitions(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id long, name string, seg int"
    rows = [(k, f"n{k}", 0) for k in range(200)] + [(None, "none", 0)]
    table = writers.PartitionedTable(spark, folder, ["id"], 8)
    table.create(spark.createDataFrame(rows, schema))
    before = files(folder)
    updates = spark.createDataFrame([(3, 30), (500, 50)], "id long, seg int")
    hit = table.upsert(updates)
    assert hit == table.touched(updates) and 1 <= len(hit) <= 2
    want = {r: r for r in rows if r[0] != 3} | {(3, "n3", 30): 0, (500, None, 50): 0}
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, want))
    after = files(folder)
    touched = {f for f in before | after if any(f"/bucket={b}/" in f for b in hit)}
    assert before - touched == after - touched and not (before & after & touched)
    table.upsert(updates)
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, want))
    assert table.upsert(updates.limit(0)) == []


def test_replace_keys_by_partition_equals_the_rewrite(spark, tmp_path):
    rows = [(k % 40, k, "old") for k in range(300)]
    new = [(5, 1, "new"), (5, 2, "new"), (99, 1, "new")]
    schema = "key int, no int, v string"
    table = writers.PartitionedTable(spark, str(tmp_path / "t"), ["key"], 16)
    table.create(spark.createDataFrame(rows, schema))
    before = files(str(tmp_path / "t"))
    table.replace_keys(spark.createDataFrame(new, schema))
    whole = writers.replace_keys(spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema), "key")
    assert sorted(map(tuple, table.read().select("key", "no", "v").collect())) == sorted(map(tuple, whole.collect()))
    assert len(before & files(str(tmp_path / "t"))) >= len(before) - 2 * 4


def test_no_list_grows_with_a_hot_key(spark):
    rows = [("hot" if k % 3 == 0 else f"g{k % 50}", k, k % 7) for k in range(3000)] + [(None, 9999, 1)]
    df = spark.createDataFrame(rows, "gene string, drug int, level int").repartition(5)
    got = aggregates.rollup_parts(df, "gene", ["drug"], ["level"], 40, low=F.col("level") < 2).collect()
    by = {}
    for r in got:
        assert 0 < len(r["items"]) <= 40 and [x.drug for x in r["items"]] == sorted(x.drug for x in r["items"])
        by.setdefault(r.gene, []).append(r)
    for gene, parts in by.items():
        own = sorted((d, v) for g, d, v in rows if g == gene)
        assert sorted(x for r in parts for x in map(tuple, r["items"])) == own
        assert sorted(r.part for r in parts) == list(range(len(parts)))
        assert {(r.n, r.low) for r in parts} == {(len(own), sum(v < 2 for _, v in own))}
    assert len(by["hot"]) >= 1000 // 40 and None not in by


def test_gram_joins_equal_comparing_all(spark):
    rng = random.Random(6)
    names = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))), k) for k in range(300)]
    parts = sorted({n[a : a + rng.randint(1, 6)] for n, _ in names for a in (0, 2)})
    got = {tuple(r) for r in links.contained(spark.createDataFrame([(p,) for p in parts], "value string"), spark.createDataFrame(names, "name string, id int")).collect()}
    want = {(p, min(k for n, k in names if p in n)) for p in parts if len(p) >= 3 and any(p in n for n, _ in names)}
    assert got == want
    dim = [(p, k) for k, p in enumerate(parts) if len(p) >= 3]
    left = spark.createDataFrame([(k, n) for n, k in names], "item int, value string")
    got = {tuple(r) for r in links.inside_match(left, "item", "value", spark.createDataFrame(dim, "name string, id int")).collect()}
    exact = {n: min(i for p, i in dim if p == n) for n, _ in names if n in dict(dim)}
    assert got == {(k, exact.get(n, min((i for p, i in dim if p in n), default=None))) for n, k in names}


def test_envelopes_of_mixed_types_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("""[{"status": "success", "data": {"metadata": {"url": "u1"}, "schema_version": "x", "source": {"a": [1]}, "n": 1}},
        {"status": "success", "data": {"url": 5, "metadata": {"url": "u2"}, "source": null}}, {"status": "failed", "data": {"metadata": {"url": "u3"}}},
        {"status": "success", "data": [1]}, {"status": "success"}, {"status": 1, "data": {}}, 7, null, {"status": "success", "data": {"url": "own", "metadata": "none"}},
        {"status": "success", "data": {"url": "own", "metadata": {"url": "u4"}, "schema_version": 3}}]""")
    (tmp_path / "b.json").write_text('{"status": "success", "data": {"metadata": {"url": "one"}}}')
    (tmp_path / "c.json").write_text('[{"status": "success", "data"')
    (tmp_path / "d.json").write_text("")
    got = tables.import_envelope_files(spark, str(tmp_path / "*.json")).select("url", "own_url", "schema_version", "source", F.expr("try_variant_get(data, '$.n', 'int')").alias("n")).collect()
    assert {tuple(r) for r in got} == {("u1", "u1", "x", '{"a":[1]}', 1), ("u2", "u2", "2", "{}", None), ("u4", "own", "3", "{}", None), ("one", "one", "2", "{}", None)}


def test_members_of_other_types_give_the_default(spark):
    df = spark.createDataFrame([('{"k": 4}',), ('{"k": "5"}',), ('{"k": "x"}',), ('{"k": null}',), ('{"k": [1]}',), ("[]",), ("{",), (None,)], "j string").select(F.try_parse_json("j").alias("v"))
    assert [r.k for r in df.select(values.variant_get(F.col("v"), "k", "int", -1).alias("k")).collect()] == [4, 5, -1, -1, -1, -1, -1, -1]
