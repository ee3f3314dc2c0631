"""Queries over predicates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import projections as p
from .registry import query
from .views import MARKET, MEDICINES, market, medicines, t


@query("SELECT p_partkey, p_brand FROM part WHERE nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, '') IS NOT NULL")
def flt01_non_blank(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").withColumn("b", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")))
    return part.where(f.non_blank("b")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al') OR contains(lower(p_brand), 'al')")
def flt02_match_any(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where(f.match_any(["p_name", "p_type", "p_brand"], "AL")).select("p_partkey", "p_name")


@query(f"WITH {MEDICINES} SELECT medicine_id FROM medicines WHERE regexp_matches(p_name, '(?i)[aeiou]l') OR regexp_matches(medicine_key, '(?i)7$')")
def flt03_match_array(spark: SparkSession, d: str) -> DataFrame:
    m = medicines(spark, d).withColumn("names", F.array("p_name", "medicine_key"))
    return m.where(f.match_array("names", "[aeiou]l", literal=False) | f.match_array("names", "7$", literal=False)).select("medicine_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation)")
def flt04_equals_ci(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    least = n.agg(F.upper(F.min("n_name")).alias("v"))
    return n.join(F.broadcast(least), F.lower("n_name") == F.lower("v")).select("n_nationkey", "n_name")


@query("SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type IN ('purchase', 'error'))")
def flt05_has_any(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return e.where(f.has_any("types", ["purchase", "error"])).select("user_id")


def _nested(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    sub = F.transform(lines, lambda x: F.struct(x.alias("title"), F.array(F.struct(x.alias("text"))).alias("content")))
    return t(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.array(F.struct(F.lit("s").alias("title"), sub.alias("subsections")))).alias("sections"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND NOT coalesce(doc_id % 5 <> 0 AND len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the'))) > 0, false)")
def flt06_nested_text_filter(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).where((F.col("lang") == "en") & f.nested_text_filter("sections", "the", negate=True)).select("doc_id")


@query("SELECT count(*) FILTER (p_size % 4 = 0) AS missing, count(*) FILTER (p_size % 4 = 1) AS empty, count(*) FILTER (p_size % 4 > 1) AS some, count(*) FILTER (p_size % 4 = 2) AS wrong_type FROM part")
def flt07_shape_counts(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("p_size") % 4
    part = t(spark, d, "part").withColumn("refs", F.when(r == 1, F.array().cast("array<string>")).when(r == 2, F.array(F.lit("x"))).when(r == 3, F.array(F.col("p_partkey").cast("string"))))
    return f.shape_counts(part, "refs")


@query("SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS first_part FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey")
def flt08_any_elem(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    big = lambda x: x["l_quantity"] > 40
    return o.where(f.any_elem("lines", big)).select("l_orderkey", f.first_elem("lines", big)["l_partkey"].alias("first_part"))


@query("SELECT event_id FROM events WHERE event_type = 'click' OR (event_type = 'error' AND value < 10) OR (event_type = 'error' AND event_id % 9 = 0)")
def flt09_pending(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_type") != "click", F.lit(1)).alias("done"), F.when(bad, F.when(F.col("value") < 10, F.lit("timeout: host")).otherwise(F.lit("not found"))).alias("error"), (bad & (F.col("event_id") % 9 == 0)).alias("retry"))
    return e.where(f.pending("error", "done", "retry", ("timeout", "http 5"))).select("event_id")


@query(f"WITH {MARKET} SELECT market_id FROM market WHERE contains(lower(brand_title), 'a') AND has_doc AND contains(lower(form), 'e') AND lower(country) <> ''")
def flt10_search_spec(spark: SparkSession, d: str) -> DataFrame:
    spec = f.SearchSpec(text="A", text_columns=["brand_title"], contains={"form": "e", "laboratory": None}, flags={"has_doc": True}, equal={"country": None})
    return spec.apply(market(spark, d)).select("market_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND role IN ('user', 'assistant')")
def flt11_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "deleted").otherwise("published").alias("status"), F.when(F.col("role").isin("user", "assistant"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))).alias("visibility"))
    return c.where(f.visible_rows("status", "visibility", 1)).select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR (doc_id % 5 <> 0 AND len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'src1') AND trim(x) <> '')) > 0)")
def flt12_match_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = _nested(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return docs.where(f.match_paths([f.nested_texts("sections"), F.array("source"), F.array(F.lit(None).cast("string"))], "src1")).select("doc_id")


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_name END), ''), p_brand, 'untitled') AS title FROM part")
def prj01_coalesce_chain(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", p.coalesce_chain(name, F.col("p_brand"), F.lit("untitled")).alias("title"))


@query(f"WITH {MARKET}, {MEDICINES} SELECT market_id, CASE WHEN has_doc THEN brand_title ELSE form END AS title, country, medicine_key FROM market JOIN medicines ON medicine_id = medicine_ref")
def prj02_product_view(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.links import join_medicine
    from ..sources.tables import union_generations

    m = market(spark, d)
    flat = m.where("has_doc").select("market_id", "medicine_ref", "country", F.col("brand_title").alias("title"))
    deep = m.where("not has_doc").select("market_id", "medicine_ref", "country", F.struct(F.col("form").alias("title")).alias("rcp"))
    both = union_generations([flat, deep]).withColumn("title", p.coalesce_chain(F.col("title"), F.col("rcp.title")))
    return join_medicine(both, medicines(spark, d).select("medicine_id", "medicine_key")).select("market_id", "title", "country", "medicine_key")


@query("SELECT doc_id, len(x) AS n, array_to_string(list_transform(x, lambda y: trim(y)), '|') AS texts FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda y: trim(y) <> '') AS x FROM documents)")
def prj03_normalise_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", p.text_items(F.split("text", "\n")).alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda x: x["text"]), "|").alias("texts"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, x, flatten(list_transform(x, lambda y: list_filter(string_split(y, '. '), lambda z: trim(z) <> ''))) AS s FROM l)
SELECT doc_id, len(x) AS n, len(list_filter(x, lambda y: trim(y) <> '')) AS n_items, len(s) AS n_below, md5(array_to_string(list_transform(x, lambda y: trim(y)), '|')) AS titles, md5(array_to_string(s, '|')) AS below FROM b""")
def prj03_normalise_sections_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document is a section with one sub-section, which holds its sentences."""
    item = lambda x: F.struct(x.alias("text"))
    section = lambda x: F.struct(F.concat(F.lit(" "), x).alias("title"), F.array(item(x), item(F.lit(" ")), item(F.lit(None).cast("string"))).alias("blocks"), F.array(F.struct(F.lit(None).cast("string").alias("title"), F.transform(F.split(x, r"\. "), item).alias("content"))).alias("subsections"))
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), section).alias("raw"))
    s = docs.select("doc_id", p.normalise_sections(F.col("raw"), items=("blocks", "content")).alias("s"))
    texts = F.flatten(F.flatten(F.transform("s", lambda x: F.transform(x["subsections"], lambda y: F.transform(y["content"], lambda z: z["text"])))))
    return s.select(
        "doc_id",
        F.size("s").cast("long").alias("n"),
        F.aggregate("s", F.lit(0), lambda n, x: n + F.size(x["content"])).cast("long").alias("n_items"),
        F.size(texts).cast("long").alias("n_below"),
        F.md5(F.array_join(F.transform("s", lambda x: x["title"]), "|")).alias("titles"),
        F.md5(F.array_join(texts, "|")).alias("below"),
    )


@query(f"WITH {MARKET}, home AS (SELECT min(n_name) AS h FROM nation) SELECT market_id, CASE WHEN country = 'FRANCE' AND has_doc THEN 1 WHEN country = 'FRANCE' THEN 2 WHEN has_doc THEN 3 ELSE 4 END AS priority, regexp_matches(brand_title, '^[A-Za-zÀ-ÿ]') AS leads_with_letter, starts_with(lower(brand_title), 'a') AS starts_with_query FROM market")
def prj04_priority_cols(spark: SparkSession, d: str) -> DataFrame:
    return p.priority_cols(market(spark, d, "market_id", "brand_title", "country", "has_doc"), "A", "FRANCE", "brand_title", "country", "has_doc").select("market_id", "priority", "leads_with_letter", "starts_with_query")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus || '|BDPM|' || o_custkey END AS key, CASE WHEN o_orderkey % 6 <> 0 THEN 'BDPM' END AS source FROM orders")
def prj05_make_key(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", p.make_key(F.col("o_orderstatus"), F.lit("BDPM"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey"))).alias("key"))
    return o.withColumn("source", p.split_key(F.col("key"), 1))


@query("SELECT c_custkey, array_to_string(list_filter(['account', 'nation', 'segment'], lambda x: CASE x WHEN 'account' THEN c_acctbal > 0 WHEN 'nation' THEN c_nationkey % 2 = 0 ELSE c_custkey % 3 = 0 END), ',') AS tags FROM customer")
def prj06_present_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = p.present_tags(segment=F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), nation=F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")), account=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return t(spark, d, "customer").select("c_custkey", F.array_join(tags, ",").alias("tags"))


@query("SELECT 'medicine:' || array_to_string(list_sort([replace(lower(trim(p_name)), ' ', '_'), replace(lower(trim(p_brand)), ' ', '_')]), '+') AS id, p_partkey, upper(trim(p_name)) AS label_normalized FROM part")
def prj07_build_records(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").withColumn("names", F.array("p_name", "p_brand"))
    return part.select(p.joint_id(F.col("names")).alias("id"), "p_partkey", F.upper(F.trim("p_name")).alias("label_normalized"))


@query("SELECT p_partkey, 'inn:' || lower(trim(p_name)) AS id, lower(trim(p_name)) AS inn_normalized, p_brand AS codes, 'not_checked' AS status, 0 AS n_sources, 3 AS schema_version FROM part")
def prj07_build_substance(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "part").select("p_partkey", p.build_substance(F.col("p_name"), F.array("p_brand")).alias("s"))
    return s.select("p_partkey", "s.id", "s.inn_normalized", F.array_join("s.atc_codes", ",").alias("codes"), "s.rxnorm.status", F.size("s.sources").alias("n_sources"), "s.schema_version")


@query("SELECT p_partkey, 'medicine:' || lower(trim(p_name)) AS id, 'inn:' || lower(trim(p_name)) AS substance_id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS forms, 0 AS n_markets FROM part")
def prj07_build_medicine(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "part").select("p_partkey", p.build_medicine(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.array("p_type"))).alias("m"))
    return m.select("p_partkey", "m.id", "m.substance_id", F.array_join("m.forms", ",").alias("forms"), F.size("m.markets").alias("n_markets"))


@query("SELECT s_suppkey, 'market:' || lower(n_name) || ':' || replace(lower(s_name), ' ', '_') AS id, 'medicine:' || lower(trim(s_name)) AS medicine_id, s_acctbal AS balance, n_name AS country, 'AUT' AS authority FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def prj07_build_market(spark: SparkSession, d: str) -> DataFrame:
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    m = rows.select("s_suppkey", p.build_market(F.col("s_name"), F.col("s_name"), F.col("n_name"), F.lit("AUT"), presentation=F.struct(F.col("s_acctbal").alias("balance"))).alias("m"))
    return m.select("s_suppkey", "m.id", "m.medicine_id", "m.presentation.balance", "m.country", "m.authority")


@query("SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def prj08_observed_fields(spark: SparkSession, d: str) -> DataFrame:
    return p.observed_fields(t(spark, d, "events"), "props")


@query(f"WITH {MARKET} SELECT market_id, CASE WHEN has_doc THEN brand_title || '|' || form ELSE laboratory END AS shown, CASE WHEN has_doc THEN (CASE WHEN brand_title = form THEN 1 ELSE 2 END) ELSE 1 END AS n_labels FROM market")
def prj09_result_row(spark: SparkSession, d: str) -> DataFrame:
    m = market(spark, d)
    own = F.when(F.col("has_doc"), F.array("brand_title", "form", "brand_title"))
    return p.result_row(m, "market_id", own, F.array("laboratory"), "unknown").select("market_id", F.array_join("shown", "|").alias("shown"), "n_labels")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type END AS chosen FROM part")
def prj10_first_nonempty_list(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("p_size") % 3
    got = p.first_nonempty_list(F.array(F.lit(" "), F.when(r == 0, F.col("p_brand"))), F.when(r != 2, F.array("p_type", F.lit(""))), F.array(F.lit("")))
    return t(spark, d, "part").select("p_partkey", F.array_join(got, ",").alias("chosen"))


@query(f"WITH {MEDICINES} SELECT medicine_id, CASE WHEN medicine_id % 4 <> 0 THEN array_to_string(refs[1:5], ',') END AS synonyms, refs[1] AS first_seen FROM medicines")
def prj11_identity_projection(spark: SparkSession, d: str) -> DataFrame:
    m = medicines(spark, d).withColumns({"label": F.when(F.col("medicine_id") % 4 != 0, F.col("p_name")), "names": F.col("refs").cast("array<string>")})
    return p.identity_projection(m, "medicine_id", "label", "names", "refs").select("medicine_id", F.array_join("identity.synonyms", ",").alias("synonyms"), "first_seen")


@query("SELECT p_partkey AS legacy, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 15))::BIGINT AS id FROM part")
def prj12_assign_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return p.assign_surrogates(t(spark, d, "part"), "p_partkey").select("legacy", "id")
