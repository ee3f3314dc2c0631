"""Operators do the whole job, on small inputs."""

import hashlib

from pyspark.sql import functions as F

from dispensa.operators import links
from dispensa.plans import registry
from dispensa.streaming import jobs


def found(df, *columns):
    return {r["item"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_knowledge_base_by_synonym_and_relation_in_candidate_order(spark):
    kb = spark.createDataFrame([(1, "Warfarin sodium", ["Coumadin forte"]), (2, "Codeine", []), (3, "Big name", ["codeine phosphate"]), (4, "Aspirin", None)], "id long, name string, synonyms array<string>")
    relations = spark.createDataFrame([("Plavix", 4), ("Plavix", 99), ("gone", 98)], "drug_name string, id long")
    names = {10: ["warfarin"], 11: ["coumadin"], 12: ["plavix"], 13: ["gone"], 14: ["big name", "codeine"], 15: ["xx", "aspirin", "codeines", "codeine"], 16: ["aspirin x", "warfarin sodium"]}
    items = spark.createDataFrame(list(names.items()), "item long, names array<string>")
    got = found(links.resolve_pgx(items, kb, relations), "match", "step")
    assert got == {10: (1, 1), 11: (1, 2), 12: (4, 3), 13: (None, None), 14: (2, 0), 15: (4, 0), 16: (1, 0)}


def test_substance_by_legacy_prefix_anywhere_and_product_path(spark):
    subs = spark.createDataFrame([(1, "Sodium phenobarbital", "Gardénal", ["luminal"]), (2, "Aspirin", None, ["asa"])], "id long, label string, legacy string, synonyms array<string>")
    meds = spark.createDataFrame([(7, ["unknown"], ["ASA"], [1]), (8, ["unknown"], None, [5, 1])], "medicine_ref long, inns array<string>, labels array<string>, refs array<long>")
    rows = [(1, "gardénal", None, "x"), (2, None, None, "Phénobarbitone 5"), (3, None, 7, "luminal"), (4, None, 8, "aspirin"), (5, None, 9, "Luminal"), (6, "none", None, "short")]
    items = spark.createDataFrame(rows, "item long, medicine_id string, medicine_ref long, label string")
    got = found(links.resolve_substance(items, subs, meds), "match", "path", "step")
    assert got == {1: (1, 0, 1), 2: (1, 4, 3), 3: (2, 2, 2), 4: (1, 3, 0), 5: (1, 4, 2), 6: (None, None, None)}


def test_identity_by_synonyms_and_names_by_key(spark):
    dim = spark.createDataFrame([(1, ["I1"], "C1", "U1", ["UNII-Z", "C7"], "Alpha"), (2, ["I2"], "C2", "U2", [], " beta ")], "id long, inchis array<string>, cas string, unii string, synonyms array<string>, label string")
    items = spark.createDataFrame([(1, None, "C7", None, "x", None), (2, None, None, "Z", "x", None), (3, None, None, None, "x", ["BETA"]), (4, "I2", "C1", None, "x", None)], "item long, inchi string, cas string, unii string, label string, synonyms array<string>")
    assert found(links.match_identity(items, dim), "match", "step") == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (2, 0)}
    meds = spark.createDataFrame([(1, "ALPHA KEY", ["A B"]), (2, "HEAD", ["C"])], "id long, key string, inns array<string>")
    asked = spark.createDataFrame([(1, "alpha key", None), (2, "head tail", None), (3, "none", "c")], "item long, generic string, brand string")
    assert found(links.resolve_names(asked, meds), "match", "step") == {1: (1, 1), 2: (2, 3), 3: (2, 4)}


def corpus(spark, tmp_path):
    rows = [(1, "Füße, été the word", "de", "src1"), (2, "the Été.\nFüße FÜSSE", None, "src2"), (3, None, "en", None), (4, "ñandú", "es", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_text_queries_take_every_language(spark, tmp_path):
    d = corpus(spark, tmp_path)
    rows = lambda name, c: {r["doc_id"]: r[c] for r in registry.queries()[name](spark, d).collect()}
    assert rows("str08_brand_like_all", "n") == {1: 3, 2: 2, 3: 0, 4: 1}
    assert rows("str13_excerpt_all", "excerpt") == {1: "Füße, été the word", 2: "the Été....", 3: None, 4: "ñandú..."}
    assert rows("str14_relevance_all", "score") == {1: 11 + 2 + 19, 2: 13, 3: 0, 4: 19}
    assert set(rows("str02_fold_accents_all", "folded")) == {1, 2, 3, 4}


def test_corpus_queries_draw_from_whole_texts(spark, tmp_path):
    text = "\n".join(f"line {k} of the text" for k in range(40))
    spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    page = "<ul><li>One</li></ul><article><h1>T</h1><p>a<br>b</p><p>c</p></article>"
    spark.createDataFrame([(5, page)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.code for r in run("doc02_split_outline_text")} == {"1", "4", "4.1", "5.2", "6.6", "10"}
    assert {(r.rubric, r.row, r.cells) for r in run("doc07_html_monograph_text")} == {("links", 0, "One"), ("article", 0, "a\nb"), ("article", 1, "c")}
    record = {r.doc_id: r for r in run("doc13_document_record_text")}
    assert record[1].sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert record[2].status == "no section found"
    assert len(run("str16_risk_class_lines")) == 40
    assert {r.doc_id: r.text for r in run("doc08_topic_text_lines")} == {1: hashlib.md5(text.encode()).hexdigest(), 2: None}


def test_result_ages_as_rows_and_as_a_stream(spark, tmp_path):
    rows = [(k, s) for k in (1, 2) for s in (0, 100, 650, 700, 1300)]
    df = spark.createDataFrame(rows, "k long, s long")
    want = {(k, s) for k in (1, 2) for s in (0, 650, 1300)}
    made = jobs.ttl_rows(df, "k", F.col("s"), 600)
    assert {tuple(r) for r in made.collect()} == want
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    for k, part in enumerate((df.where("s < 650"), df.where("s >= 650"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    seen = []
    jobs.run_available(jobs.ttl_stream(stream, "k", "s", 600), lambda batch, number: seen.extend(tuple(r) for r in batch.collect()), jobs.work_dir(spark), "append")
    assert set(seen) == want
    assert len(seen) == len(want)
