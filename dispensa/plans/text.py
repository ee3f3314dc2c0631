"""Queries over text and value expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import values as v
from .registry import oracle_sql_of, query
from .views import MEDICINES, medicines, t


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS space, upper(trim(source)) AS label, md5(lower(trim(regexp_replace(source || '  ' || lang, '\\s+', ' ', 'g')))) AS search FROM documents")
def str01_normalise(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(x.norm_space(F.col("text"))).alias("space"), x.norm_label(F.col("source")).alias("label"), F.md5(x.norm_search(F.concat_ws("  ", "source", "lang"))).alias("search"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def str02_fold_accents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(x.fold_accents(F.col("text"))).alias("folded"))


@query("SELECT p_partkey, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || ' CO-TAB TAB' AS name FROM part")
def str03_clean_generic(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", x.clean_generic(F.concat("p_name", F.lit(" "), "p_size", F.lit(".5 mg co-tab (20 units) tab"))).alias("name"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || ' boîte de 30' AS name FROM part")
def str04_clean_product(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", x.clean_product(F.concat("p_name", F.lit(" "), "p_size", F.lit(" mg Sulfate comprimé, poudre pour boîte de 30"))).alias("name"))


@query("SELECT p_partkey, p_name || ' (DC) ' || p_size || ' mg - base|' || p_name || ' - base|' || p_name || ' (DC) ' || p_size || ' mg|' || p_name || ' DC ' || p_size || ' mg - base' AS variants FROM part")
def str05_name_variants(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.array_join(x.name_variants(F.concat("p_name", F.lit(" (DC) "), "p_size", F.lit(" mg - base"))), "|").alias("variants"))


@query("SELECT p_partkey, 'sulfate d ' || p_brand || '|' || p_brand || ' sulfate|' || p_brand AS variants FROM part")
def str06_salt_variants(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.array_join(x.salt_variants(F.concat(F.lit("sulfate d "), "p_brand"), {"zzz": "y"}), "|").alias("variants"))


@query("SELECT p_partkey, upper(p_brand) AS name FROM part")
def str07_strip_chem_prefix(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", x.strip_chem_prefix(F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("L-")).otherwise(F.lit("17 β ")), "p_brand", F.lit("*"))).alias("name"))


@query("SELECT doc_id, (SELECT count(DISTINCT upper(w)) FROM (SELECT trim(unnest(string_split(regexp_replace(text, '[^ -~]', '1', 'g'), ' '))) AS w) WHERE regexp_matches(w, '^[A-Za-z][A-Za-z-]{1,29}$')) AS n FROM documents")
def str08_brand_like(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.size(x.brand_like(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "1"), " "), 1_000_000)).cast("long").alias("n"))


@query("SELECT page_id, length(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s', '', 'g')) AS n FROM pages")
def str09_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.length(F.regexp_replace(x.strip_tags(F.col("html")), r"\s", "")).cast("long").alias("n"))


@query("SELECT p_partkey, p_name AS title FROM part")
def str10_title_head(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", x.title_head(F.concat("p_name", F.lit(" "), "p_size", F.lit(" mg, gel (x) - y"))).alias("title"))


@query("SELECT page_id, CASE WHEN contains(lower(split_part(split_part(url, '/', 3), '?', 1)), 'site1') THEN 'one' WHEN contains(lower(split_part(split_part(url, '/', 3), '?', 1)), 'example') THEN 'example' ELSE 'other' END AS source, coalesce(nullif(regexp_extract(url, '[?&][A-Za-z_]+=([0-9]+)', 1), ''), nullif(regexp_extract(split_part(url, '?', 1), '([0-9]+)', 1), '')) AS id FROM pages")
def str11_url_facts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", x.url_source(F.col("url"), {"site1": "one", "example": "example"}).alias("source"), x.url_id(F.col("url")).alias("id"))


@query("WITH w AS (SELECT p_partkey, list_reduce(string_split(p_name, ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS l FROM part) SELECT p_partkey, CASE WHEN length(l) >= 6 THEN substr(l, 1, 7) END AS prefix FROM w")
def str12_longest_word_prefix(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", x.longest_word_prefix(F.col("p_name")).alias("prefix"))


@query("""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'the ') - 1 AS p, length(text) AS size FROM documents), b AS (SELECT *, reverse(substr(text, 1, p)) AS bef, substr(text, p + 1) AS rest FROM a),
c AS (SELECT *, CASE WHEN strpos(bef, '.') > 0 AND p - strpos(bef, '.') > 0 THEN p - strpos(bef, '.') WHEN strpos(bef, '?') > 0 THEN p - strpos(bef, '?') ELSE 0 END AS s, CASE WHEN strpos(rest, '.') > 0 THEN p + strpos(rest, '.') WHEN strpos(rest, '!') > 0 THEN p + strpos(rest, '!') - 1 WHEN strpos(rest, '?') > 0 THEN p + strpos(rest, '?') - 1 ELSE size END AS e FROM b),
d AS (SELECT *, CASE WHEN e - s > 150 THEN greatest(0, p - 60) ELSE s END AS lo, CASE WHEN e - s > 150 THEN least(size, p + 64) ELSE e END AS hi FROM c)
SELECT doc_id, CASE WHEN p >= 0 THEN CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(text, lo + 1, hi - lo) || CASE WHEN hi < size THEN '...' ELSE '' END ELSE substr(text, 1, 100) || '...' END AS excerpt FROM d""")
def str13_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", x.excerpt(F.col("text"), "the ").alias("excerpt"))


@query("""WITH b AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(text) AS body, lower(source) AS s FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents)), n AS (SELECT doc_id, (length(title) - length(replace(title, 'the', ''))) // 3 AS a, (length(body) - length(replace(body, 'the', ''))) // 3 AS c, (length(s) - length(replace(s, 'src1', ''))) // 4 AS k, s = 'src1' AS same, (length(title) - length(replace(title, 'src1', ''))) // 4 AS ta, (length(body) - length(replace(body, 'src1', ''))) // 4 AS tc FROM b)
SELECT doc_id, a * 11 + c * 2 + ta * 11 + tc * 2 + k * 9 + CASE WHEN same THEN 10 ELSE 0 END AS score FROM n""")
def str14_relevance(spark: SparkSession, d: str) -> DataFrame:
    title = F.split("text", "\n")[0]
    return t(spark, d, "documents").select("doc_id", x.relevance(title, F.array("source"), F.lit(""), F.lit(""), F.col("text"), ["the", "src1"]).cast("long").alias("score"))


@query("""WITH f AS (SELECT p_partkey, unnest([{'f': 'name', 'p': 1, 't': p_name}, {'f': 'brand', 'p': 2, 't': p_brand}, {'f': 'type', 'p': 3, 't': p_type}]) AS x FROM part), h AS (SELECT p_partkey, x.f AS place, x.p AS priority, term, (length(lower(x.t)) - length(replace(lower(x.t), term, ''))) // length(term) AS n FROM f, (VALUES ('a'), ('br')) AS v(term))
SELECT p_partkey, place, term, n, priority FROM h WHERE n > 0""")
def str15_hit_locations(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(k).alias("priority"), F.col(c).alias("t")) for k, (n, c) in enumerate((("name", "p_name"), ("brand", "p_brand"), ("type", "p_type")), 1)])
    rows = t(spark, d, "part").select("p_partkey", F.explode(fields).alias("f"))
    hits = F.explode(F.array(*[F.struct(F.lit(term).alias("term"), x.count_term(F.col("f.t"), term).alias("n")) for term in ("a", "br")]))
    return rows.select("p_partkey", "f.place", "f.priority", hits.alias("h")).where("h.n > 0").select("p_partkey", "place", "h.term", F.col("h.n").cast("long").alias("n"), "priority")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'danger' WHEN doc_id % 5 = 1 THEN 'deconseille' WHEN doc_id % 5 = 2 THEN 'precaution' WHEN doc_id % 5 = 3 THEN 'ok' ELSE 'unknown' END AS level, CASE WHEN doc_id % 5 = 0 THEN 'danger' WHEN doc_id % 5 = 1 THEN 'deconseille' ELSE 'precaution' END AS worst FROM documents")
def str16_risk_class(spark: SparkSession, d: str) -> DataFrame:
    words = ["Ce produit est contre-indiqué.", "Usage à éviter", "Avec prudence", "Peut être utilisé", " "]
    docs = t(spark, d, "documents").select("doc_id", x.risk_class(F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % 5).cast("int"))).alias("level"))
    return docs.withColumn("worst", x.worst_level(F.col("level"), F.lit("precaution")))


@query("SELECT event_id, 'T' || (100 + event_id % 800) || ',rien' AS codes FROM events")
def str17_extract_codes(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("event_id") % 800 + 100).cast("string")
    items = F.array(F.concat(F.lit("Allergie K12 T"), code), F.lit("Non concerné ."), F.lit("rien"), F.concat(F.lit("x T"), code))
    return t(spark, d, "events").select("event_id", F.array_join(x.extract_codes(items), ",").alias("codes"))


@query("SELECT p_partkey, p_name AS substance, p_size || ' mg' AS dosage FROM part")
def str18_parse_composition(spark: SparkSession, d: str) -> DataFrame:
    c = x.parse_composition(F.concat("p_name", F.lit(" ........ "), "p_size", F.lit(" mg")))
    return t(spark, d, "part").select("p_partkey", c["substance"].alias("substance"), c["dosage"].alias("dosage"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders")
def str19_extract_update_date(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("mis à jour le : "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("."))).otherwise(F.lit("jamais"))
    return t(spark, d, "orders").select("o_orderkey", x.extract_update_date(line, "mis à jour le").alias("day"))


@query("SELECT conv_id, turn, '<h3>T</h3><br><strong>' || role || '</strong><br>end' AS html FROM conversations")
def str20_md_to_html(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", x.md_to_html(F.concat(F.lit("## T\n**"), "role", F.lit("**\nend"))).alias("html"))


@query("SELECT doc_id, md5(coalesce(lang, '') || '|' || coalesce(text, '')) AS a, sha256(coalesce(text, '')) AS b FROM documents")
def str21_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", x.fingerprint("md5", F.col("lang"), F.col("text")).alias("a"), x.fingerprint("sha256", F.col("text")).alias("b"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y%m%d')::INT END AS ymd FROM orders")
def dt01_dates(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    some = F.col("o_orderkey") % 4 != 0
    return o.select("o_orderkey", v.epoch_date(F.when(some, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))).alias("day"), v.ymd_int(F.when(some, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("2020"))).alias("ymd"))


@query("SELECT event_id, floor(epoch(max(ts) OVER (PARTITION BY user_id)))::BIGINT - floor(epoch(ts))::BIGINT < 600 AS fresh FROM events")
def dt02_is_fresh(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    last = e.groupBy("user_id").agg(F.max("s").alias("now"))
    return e.join(last, "user_id").select("event_id", v.is_fresh(F.col("s"), F.col("now")).alias("fresh"))


@query(f"WITH {MEDICINES} SELECT medicine_id, array_to_string(refs[1:3], ',') AS three, list_filter(refs, lambda x: x > 5)[1] AS first_big FROM medicines")
def arr01_slices(spark: SparkSession, d: str) -> DataFrame:
    return medicines(spark, d).select("medicine_id", F.array_join(v.slice_n(F.col("refs"), 3).cast("array<string>"), ",").alias("three"), v.first_where(F.col("refs"), lambda x: x > 5).alias("first_big"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing FROM events")
def json01_safe_get(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", v.safe_get(F.col("props"), "k", "none").alias("k"), v.safe_get(F.col("props"), "a.b", "none").alias("missing"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN json_extract(props, '$.k')::BIGINT WHEN 1 THEN json_extract(props, '$.k')::BIGINT WHEN 5 THEN 1 ELSE -1 END AS k, CASE event_id % 6 WHEN 3 THEN user_id ELSE 0 END AS deep, event_id % 6 <> 4 AS parsed FROM events""")
def json01_variant_get(spark: SparkSession, d: str) -> DataFrame:
    """Properties whose k is a number, a text of one, a text of none, an object, or true; one in six is no JSON."""
    kind, k, user = F.col("event_id") % 6, F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    mixed = F.when(kind == 1, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(kind == 2, F.lit('{"k": "many"}')).when(kind == 3, F.concat(F.lit('{"k": {"n": ['), user, F.lit("]}}"))).when(kind == 4, F.substring("props", 1, 4)).when(kind == 5, F.lit('{"k": true}')).otherwise(F.col("props"))
    p = t(spark, d, "events").select("event_id", F.try_parse_json(mixed).alias("p"))
    return p.select("event_id", v.variant_get(F.col("p"), "k", "bigint", -1).alias("k"), v.variant_get(F.col("p"), "k.n[0]", "bigint", 0).alias("deep"), F.col("p").isNotNull().alias("parsed"))


@query("SELECT l_orderkey, 1 AS level, '/' || i AS path, 'h' || l_partkey AS heading FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem) UNION ALL SELECT l_orderkey, 2, '/' || i || '/0', 's' || l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)")
def json02_walk_sections(spark: SparkSession, d: str) -> DataFrame:
    inner = F.array(F.struct(F.concat(F.lit("s"), "l_suppkey").alias("TOCHeading")))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.concat(F.lit("h"), "l_partkey").alias("TOCHeading"), inner.alias("Section")).alias("x"))))
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    return v.walk_sections(x.select("l_orderkey", F.to_json(F.struct(F.transform("r", lambda s: s["x"]).alias("Section"))).alias("json")), "l_orderkey", "json")


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 5), 40) AS q FROM lineitem")
def math01_clamp(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", v.clamp(F.col("l_quantity"), 5.0, 40.0).alias("q"))


# The same operators under the names of their whole-table queries; brand_like with letters of every language.
@query(oracle_sql_of("str02_fold_accents"))
def str02_fold_accents_all(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(x.fold_accents(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, (SELECT count(DISTINCT upper(translate(replace(w, 'ß', 'ss'), '{x.ACCENTED}', '{x.FOLDED}'))) FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w) WHERE regexp_matches(w, '^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ-]{{1,29}}$')) AS n FROM documents")
def str08_brand_like_all(spark: SparkSession, d: str) -> DataFrame:
    words = x.brand_like(F.split("text", "[ \\n]+"), 1_000_000)
    return t(spark, d, "documents").select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(words)).cast("long").alias("n"))


@query(oracle_sql_of("str13_excerpt"))
def str13_excerpt_all(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", x.excerpt(F.col("text"), "the ").alias("excerpt"))


@query(oracle_sql_of("str14_relevance"))
def str14_relevance_all(spark: SparkSession, d: str) -> DataFrame:
    title = F.split("text", "\n")[0]
    return t(spark, d, "documents").select("doc_id", x.relevance(title, F.array("source"), F.lit(""), F.lit(""), F.col("text"), ["the", "src1"]).cast("long").alias("score"))
