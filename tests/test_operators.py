"""Operators on small literal rows, among them nulls, empties and ties."""

from pyspark.sql import functions as F

from dispensa.functions import text as x
from dispensa.operators import aggregates, corpus, filters, links, projections, ranking, sets
from dispensa.sources import tables, writers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


MEDICINES = [(10, ["ALPHA"], [1]), (11, ["BETA"], [2, 1]), (12, ["BETA"], [2, 99]), (13, [], [])]
MARKET = [("a", "Alpha", "FR", True, 10), ("b", "Alphabet", "FR", False, 11), ("c", "Alpha U", "US", True, 12), ("d", "1-Alpha", "US", False, 77), ("e", None, "DE", False, None)]
SUBSTANCES = [(1, "ALPHA"), (2, "BETA"), (3, "GAMMA")]


def entities(spark):
    return (
        spark.createDataFrame(MARKET, "market_id string, brand string, country string, doc boolean, medicine_ref long"),
        spark.createDataFrame(MEDICINES, "medicine_id long, inns array<string>, refs array<long>"),
        spark.createDataFrame(SUBSTANCES, "substance_id long, label string"),
    )


def test_search_and_order(spark):
    market, medicines, substances = entities(spark)
    hits = market.where(filters.match_any(["brand"], "alpha"))
    ranked = projections.priority_cols(hits, "alpha", "FR", "brand", "country", "doc")
    assert [r.market_id for r in ranking.page(ranked, ["priority", "market_id"]).collect()] == ["a", "b", "c", "d"]
    assert links.search_semijoin(market, F.lit(False), medicines, filters.match_array("inns", "gamma"), substances, filters.matches("label", "gamma")).count() == 0
    assert {r.market_id for r in links.filter_by_substance(market, medicines, substances, F.col("substance_id") == 2).collect()} == {"b", "c"}


def test_counts_and_links(spark):
    market, medicines, substances = entities(spark)
    assert [tuple(r) for r in aggregates.top_counts(market, "country").collect()] == [("FR", 2), ("US", 2), ("DE", 1)]
    top = {(r.substance_id, r.n, r.label) for r in aggregates.top_linked(medicines, "refs", substances, "substance_id", "label").collect()}
    assert top == {(1, 2, "ALPHA"), (2, 2, "BETA"), (99, 1, "(unknown)")}
    assert [r.market_id for r in links.orphans(market, "medicine_ref", medicines, "medicine_id").collect()] == ["d"]
    assert [r.medicine_id for r in links.array_orphans(medicines, "medicine_id", "refs", substances, "substance_id").collect()] == [12]
    names = {r.medicine_id: r.labels for r in links.join_array_fk(medicines, "medicine_id", "refs", substances, "substance_id", "label", "labels").collect()}
    assert names == {10: ["ALPHA"], 11: ["BETA", "ALPHA"], 12: ["BETA"], 13: []}
    shape = filters.shape_counts(medicines.withColumn("refs", F.col("refs").cast("array<string>")), "refs").first()
    assert (shape.missing, shape.empty, shape.some) == (0, 1, 3)


def test_ragged_lines_and_ratings(spark, tmp_path):
    lines = ["60000001\tgel\t100\tALPHA\t5 mg\tun tube\tSA\t1", "60000001\tgel\t101\tBETA\t1 mg\tun\ttube\tFT\t2", "60000001\tgel\t102\tGAMMA\t2 mg\tun tube\tSA\t3\t", "6000\tx", ""]
    got = tables.repair_ragged(spark.createDataFrame([(v,) for v in lines], "line string")).orderBy("rank").collect()
    assert [(r.label, r.reference, r.kind, r["rank"]) for r in got] == [("ALPHA", "un tube", "SA", 1), ("BETA", "un tube", "FT", 2), ("GAMMA", "un tube", "SA", 3)]
    (tmp_path / "r.txt").write_bytes("60000001\tCT-1\tInscription\t20200101\tModéré\t\n60000001\tCT-2\tRenouvellement\t20230601\tImportant\tok\n60000001\tCT-3\tAutre\t2023\tx\t\n12\tno\n".encode("latin-1"))
    rows = tables.scan_tsv(spark, str(tmp_path / "r.txt"), ["code", "file", "event", "day", "value", "comment"])
    rows = rows.withColumn("day", tables.ymd_or_null(F.col("day")))
    assert {(r.file, r.day, r.value, r.comment) for r in rows.collect()} == {("CT-1", 20200101, "Modéré", None), ("CT-2", 20230601, "Important", "ok"), ("CT-3", None, "x", None)}
    best = aggregates.latest_by(rows, "code", "day", "file", "value").first()
    assert (best.latest, best.has_any) == ("Important", True)


def test_drug_xml_takes_outer_elements(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<drugbank><drug><drugbank-id primary="true">DBX1</drugbank-id><drugbank-id>OLD1</drugbank-id><name>Alpha</name><synonyms><synonym>alfa</synonym><synonym>ALFA</synonym></synonyms>'
        '<atc-codes><atc-code code="X01"/><atc-code code="X01"/></atc-codes><external-identifiers><external-identifier><resource>CAS</resource><identifier>1-1</identifier></external-identifier></external-identifiers>'
        "<pathways><pathway><name>p</name><drugs><drug><drugbank-id>DBX9</drugbank-id><name>N</name></drug></drugs></pathway></pathways></drug></drugbank>"
    )
    rows = tables.scan_drug_xml(spark, str(tmp_path / "d.xml")).collect()
    assert [(r.drug_id, r.all_ids, r.synonyms, r.atc_codes, r.cas, r.pathways[0].name) for r in rows] == [("DBX1", ["DBX1", "OLD1"], ["alfa"], ["X01"], "1-1", "p")]


def test_json_and_binary_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"_id": {"$oid": "x"}, "name": "n", "id": 3}]')
    assert tables.import_json_array(spark, str(tmp_path / "a.json")).columns == ["id", "name"]
    (tmp_path / "60000001").mkdir()
    (tmp_path / "60000001" / "f.pdf").write_bytes(b"abc")
    (tmp_path / "g.pdf").write_bytes(b"abc")
    rows = tables.scan_binary_corpus(spark, str(tmp_path)).collect()
    assert [(r.document, r.file, r.length) for r in rows] == [("60000001", "f.pdf", 3)]
    pages = spark.createDataFrame([(1, [("1-1-1",), (None,)]), (2, []), (3, None)], "id int, packaging array<struct<code:string>>")
    assert [r.package.code for r in tables.explode_packages(pages, "packaging", "code").collect()] == ["1-1-1"]
    path = writers.snapshot(pages, str(tmp_path / "s"), "t1")
    assert spark.read.parquet(path).count() == 3


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id int, v string, created string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, None, "t1")], "id int, v string, created string")
    want = {(1, "a", "t0"), (2, "B", "t0"), (3, None, "t1")}
    once = writers.upsert(old, new, ["id"], ("created",))
    assert set(map(tuple, once.collect())) == want
    assert set(map(tuple, writers.upsert(once, new, ["id"], ("created",)).collect())) == want
    chunks = spark.createDataFrame([(1, [(5,), (5,), (5,), (9,)])], "id int, items array<struct<size:int>>")
    assert sorted((r.chunk, r.n_items, r.bytes) for r in writers.chunk_by_size(chunks, ["id"], "items", "size", 10).collect()) == [(0, 2, 10), (1, 1, 5), (2, 1, 9)]


def test_names(spark):
    assert one(spark, x.clean_generic, "Ibuprofen 25.5 mg/tab") == "IBUPROFEN TAB"
    assert one(spark, x.name_variants, "Paracétamol (DC) 500 mg - base") == ["Paracétamol (DC) 500 mg - base", "Paracétamol - base", "Paracétamol (DC) 500 mg", "Parac tamol DC 500 mg - base"]
    assert one(spark, x.salt_variants, "sulfate d abacavir") == ["sulfate d abacavir", "abacavir sulfate", "abacavir"]
    assert one(spark, x.brand_like, ["Alphacin", "alphacin", "C-12", "Béta-Plus", "x"], "array<string>") == ["ALPHACIN", "BETA-PLUS"]
    assert one(spark, ranking.french_date_key, "03/11/2021") == 20211103 and one(spark, ranking.french_date_key, "2021-11-03") == 0 and one(spark, ranking.french_date_key, None) == 0
    assert one(spark, x.extract_codes, ["Allergie T784", "Non concerné .", "Malabsorption K90 K908", "rien"], "array<string>") == ["T784", "K908", "rien"]
    levels = {"Ce produit est contre-indiqué.": "danger", "Doit être évité, contre-indiqué": "danger", "Usage à éviter": "deconseille", "Avec prudence": "precaution", "Peut être utilisé": "ok", " ": "unknown", None: "unknown"}
    assert all(one(spark, x.risk_class, k) == v for k, v in levels.items())
    assert one(spark, lambda c: x.excerpt(c, "alpha"), "Un. Deux alpha ici. Trois.") == ".... Deux alpha ici...."
    assert one(spark, lambda c: x.relevance(c, F.array(F.lit("alpha")), F.lit("gel"), F.lit(""), F.lit(""), ["alpha"]), "Alpha gel") == 30
    assert one(spark, ranking.sort_section_codes, ["10", "4.1", "4", "1"], "array<string>") == ["1", "4", "4.1", "10"]


def test_name_cascade(spark):
    _, medicines, _ = entities(spark)
    dim = medicines.select(F.explode("inns").alias("value"), F.col("medicine_id").alias("id"))
    items = spark.createDataFrame([(1, "Alpha 5 mg", None), (2, "Alpha acetate", None), (3, "BETA", None), (4, None, "BETA")], "item int, generic string, brand string")
    name = x.clean_generic(F.col("generic"))
    got = {r.item: r.match for r in links.ranked_match(items, "item", [(name, dim, False), (x.first_word(name), dim, False), (F.col("brand"), dim, True)]).collect()}
    assert got == {1: 10, 2: 10, 3: 11, 4: None}


def test_interactions(spark):
    edges = spark.createDataFrame([("A", "B", "x"), ("B", "A", "y"), ("C", "A", "z")], "src string, dst string, description string")
    baskets = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (1, "A")], "basket int, item string")
    assert {tuple(r) for r in links.pair_interactions(baskets, edges).select("a", "b", "description").collect()} == {("A", "B", "x"), ("A", "C", "z")}
    items = spark.createDataFrame([(1, i, a) for i, v in (("A", "e1 e2"), ("B", "e2 e1"), ("C", "e3")) for a in v.split()], "basket int, item string, attribute string")
    assert [(r.a, r.b, r.common) for r in links.shared_attribute_pairs(items).collect()] == [("A", "B", ["e1", "e2"])]


def test_outline_and_tree(spark):
    text = "preamble\nRÉSUMÉ DES CARACTÉRISTIQUES DU PRODUIT\n1.\nNOM\nAlpha 10 mg, gel\n4. DONNEES\n4.1. Indications\nTexte A\n7.1. Autre\nTexte B\n12. Suite\nANNEXE II\nx"
    s = corpus.split_outline(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text")
    assert {r.code: r.text for r in s.collect()} == {"1": "1. NOM\nAlpha 10 mg, gel", "4": "4. DONNEES", "4.1": "4.1. Indications\nTexte A\nTexte B\n12. Suite"}
    assert {r.code: r.parent for r in corpus.section_tree(s, "id").collect()} == {"1": None, "4": None, "4.1": "4"}
    assert one(spark, x.title_head, "Alpha 10 mg, gel") == "Alpha"


def test_arrays_and_sets(spark):
    assert one(spark, lambda c: aggregates.dedup_by_hash(c, lambda v: v), ["h1", None, "h1", None], "array<string>") is not None
    df = spark.createDataFrame([([("h1", 1), (None, 2), ("h1", 3), (None, 4)],)], "v array<struct<h:string,n:int>>")
    assert [r.n for r in df.select(aggregates.dedup_by_hash(F.col("v"), lambda s: s["h"]).alias("r")).first().r] == [1, 2, 4]
    pair = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], None), (None, [])], "a array<string>, b array<string>")
    assert [r.c for r in pair.select(sets.changed(F.col("a"), F.col("b")).alias("c")).collect()] == [False, True, False]


def test_nearest_vectors(spark):
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "id int, v array<float>")
    assert [(r.id, round(r.score, 4)) for r in ranking.vector_topk(v, "id", "v", F.array(F.lit(1.0), F.lit(0.0)), 2).collect()] == [(1, 1.0), (2, 0.7071)]


def test_risk_ladder_rungs(spark):
    from dispensa.functions import text

    cases = {
        "Ne pas utiliser pendant la grossesse.": "danger",
        "Usage à ÉVITER, prudence": "deconseille",
        "N'est pas recommandé": "deconseille",
        "Utiliser sous surveillance": "precaution",
        "Compatible avec l'allaitement": "ok",
        "Ce n'est pas possible.": "unknown",
        "Neutral words": "unknown",
        " ": "unknown",
    }
    cases |= {word.upper(): next(x for x in text.RISKS if any(w in word for w in text.RISKS[x])) for words in text.RISKS.values() for word in words}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r.t: r.level for r in df.select("t", text.risk_class(F.col("t")).alias("level")).collect()}
    assert got == cases | {None: "unknown"}


def test_names_are_cleaned(spark):
    from dispensa.functions import text

    df = spark.createDataFrame([("Co-Trimoxazole  25 units (x)", "Fer 80 mg, sulfate - comprimé pour gel"), ("abc 2.5mg/5 u.i.x", "Crème Élan 5%d 3ml"), (None, None)], "a string, b string")
    got = [tuple(r) for r in df.select(text.clean_generic(F.col("a")), text.clean_product(F.col("b"))).collect()]
    assert got == [("CO-TRIMOXAZOLE X", "fer"), ("ABC X", "élan d"), (None, None)]
