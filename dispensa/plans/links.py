"""Queries over links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_generic, first_word, fold_accents, longest_word_prefix
from ..operators import links as k
from ..operators.filters import match_any, matches
from .registry import query
from .views import MARKET, MEDICINES, market, medicines, substances, t


@query(f"WITH {MARKET}, {MEDICINES} SELECT market_id, medicine_key FROM market LEFT JOIN medicines ON medicine_id = medicine_ref AND medicine_id % 7 <> 0")
def jn01_join_medicine(spark: SparkSession, d: str) -> DataFrame:
    return k.join_medicine(market(spark, d, "market_id", "medicine_ref"), medicines(spark, d).where("medicine_id % 7 <> 0").select("medicine_id", "medicine_key")).select("market_id", "medicine_key")


@query(f"WITH {MEDICINES} SELECT medicine_id, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE list_contains(refs, s_suppkey) AND s_suppkey % 3 <> 0), '') AS labels FROM medicines")
def jn02_join_array_fk(spark: SparkSession, d: str) -> DataFrame:
    out = k.join_array_fk(medicines(spark, d), "medicine_id", "refs", substances(spark, d).where("substance_id % 3 <> 0"), "substance_id", "label", "labels")
    return out.select("medicine_id", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {MARKET}, {MEDICINES}, hit AS (SELECT medicine_id FROM medicines WHERE contains(lower(p_name), 'lime') UNION SELECT medicine_id FROM (SELECT medicine_id, unnest(refs) AS s FROM medicines) JOIN supplier ON s = s_suppkey WHERE contains(s_name, '7')) SELECT market_id FROM market WHERE contains(lower(form), 'brass') OR medicine_ref IN (SELECT medicine_id FROM hit)")
def jn03_search_semijoin(spark: SparkSession, d: str) -> DataFrame:
    return k.search_semijoin(market(spark, d, "market_id", "medicine_ref", "form"), match_any(["form"], "brass"), medicines(spark, d), matches("p_name", "lime"), substances(spark, d), matches("label", "7")).select("market_id")


@query(f"WITH {MARKET}, {MEDICINES} SELECT market_id FROM market WHERE medicine_ref IN (SELECT medicine_id FROM (SELECT medicine_id, unnest(refs) AS s FROM medicines) WHERE s = 3)")
def jn04_filter_by_substance(spark: SparkSession, d: str) -> DataFrame:
    return k.filter_by_substance(market(spark, d, "market_id", "medicine_ref"), medicines(spark, d), substances(spark, d), F.col("substance_id") == 3).select("market_id")


@query("SELECT c_custkey, n_name, n_name IS NOT NULL AS has_nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = c_nationkey")
def jn05_enrich_lookup(spark: SparkSession, d: str) -> DataFrame:
    return k.enrich_lookup(t(spark, d, "customer"), t(spark, d, "nation").where("n_nationkey % 4 <> 0").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey", "has_nation").select("c_custkey", "n_name", "has_nation")


@query("SELECT c_custkey, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS orders FROM customer")
def jn06_enrich_grouped(spark: SparkSession, d: str) -> DataFrame:
    out = k.enrich_grouped(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").where("o_orderstatus = 'O'"), "o_custkey", [-F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")], ["o_orderkey"], "orders")
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey * 10 END AS o_custkey, o_custkey % 7 <> 0 AS matched FROM orders")
def jn07_rewrite_fk(spark: SparkSession, d: str) -> DataFrame:
    ids = t(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") * 10).alias("new"))
    return k.rewrite_fk(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ids, "old", "new")


@query(f"WITH {MEDICINES} SELECT medicine_id, array_to_string(list_transform(list_filter(refs, lambda x: x % 3 <> 0), lambda x: x * 10), ',') AS refs, len(list_filter(refs, lambda x: x % 3 = 0)) AS missing FROM medicines")
def jn08_rewrite_array_fk(spark: SparkSession, d: str) -> DataFrame:
    ids = substances(spark, d).where("substance_id % 3 <> 0").select(F.col("substance_id").alias("old"), (F.col("substance_id") * 10).alias("new"))
    return k.rewrite_array_fk(medicines(spark, d), "medicine_id", "refs", ids, "old", "new").select("medicine_id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), "missing")





@query("""WITH dim AS (SELECT p_partkey AS id, upper(p_name) AS name, upper(split_part(p_name, ' ', 1)) AS word, upper(p_brand) AS brand FROM part WHERE p_partkey % 2 = 0),
items AS (SELECT p_partkey AS k, upper(p_name) AS name, upper(split_part(p_name, ' ', 1)) AS word, upper(p_brand) AS brand FROM part),
one AS (SELECT brand, min(id) AS id FROM dim GROUP BY brand HAVING count(*) = 1),
steps AS (SELECT k, 0 AS step, id FROM items JOIN dim USING (name) UNION ALL SELECT k, 1, dim.id FROM items JOIN dim ON items.word = dim.word UNION ALL SELECT k, 2, one.id FROM items JOIN one ON items.brand = one.brand)
SELECT items.k AS item, b.match, b.step FROM items LEFT JOIN (SELECT k, arg_min(id, (step, id)) AS match, min(step) AS step FROM steps GROUP BY k) b ON b.k = items.k""")
def jn09_resolve_names(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    items = part.select(F.col("p_partkey").alias("item"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit(" mg")).alias("generic"), "p_brand")
    dim = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.upper("p_brand").alias("brand"))
    name = clean_generic(F.col("generic"))
    return k.ranked_match(items, "item", [(name, dim.select(F.col("name").alias("value"), "id"), False), (first_word(name), dim.select(first_word(F.col("name")).alias("value"), "id"), False), (F.upper("p_brand"), dim.select(F.col("brand").alias("value"), "id"), True)])


@query("""WITH steps AS (SELECT a.s_suppkey AS k, 0 AS step, b.s_suppkey AS id FROM supplier a JOIN supplier b ON md5(a.s_name) = md5(b.s_name) WHERE b.s_suppkey % 3 = 0
UNION ALL SELECT a.s_suppkey, 1, b.s_suppkey FROM supplier a JOIN supplier b ON a.s_nationkey * 100 + 1 = b.s_nationkey * 100 + 1 WHERE b.s_suppkey % 3 = 1
UNION ALL SELECT a.s_suppkey, 2, b.s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey % 10 = b.s_suppkey % 10)
SELECT k AS item, arg_min(id, (step, id)) AS match, min(step) AS step FROM steps GROUP BY k""")
def jn10_match_identity(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    items = s.select(F.col("s_suppkey").alias("item"), F.md5("s_name").alias("inchi"), (F.col("s_nationkey") * 100 + 1).alias("cas"), (F.col("s_suppkey") % 10).alias("unii"))
    dim = lambda where, value: s.where(where).select(value.alias("value"), F.col("s_suppkey").alias("id"))
    return k.ranked_match(items, "item", [(F.col("inchi"), dim("s_suppkey % 3 = 0", F.md5("s_name")), False), (F.col("cas"), dim("s_suppkey % 3 = 1", F.col("s_nationkey") * 100 + 1), False), (F.col("unii"), dim("true", F.col("s_suppkey") % 10), False)])


@query("""WITH words AS (SELECT p_partkey AS item, upper(p_name) AS name, list_reduce(string_split(upper(p_name), ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest FROM part),
dim AS (SELECT p_partkey AS id, upper(p_name) AS name, split_part(upper(p_name), ' ', 2) AS synonym, list_reduce(string_split(upper(p_name), ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest FROM part WHERE p_partkey % 5 = 0),
steps AS (SELECT item, 0 AS step, id FROM words JOIN dim USING (name) UNION ALL SELECT item, 1, id FROM words JOIN dim ON split_part(words.name, ' ', 1) = dim.synonym AND dim.synonym <> '' UNION ALL SELECT item, 2, id FROM words JOIN dim ON substr(words.longest, 1, 7) = substr(dim.longest, 1, 7) AND length(words.longest) >= 6 AND length(dim.longest) >= 6)
SELECT words.item, m.match, m.step FROM words LEFT JOIN (SELECT item, arg_min(id, (step, id)) AS match, min(step) AS step FROM steps GROUP BY item) m ON m.item = words.item""")
def jn11_resolve_substance(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select(F.col("p_partkey").alias("item"), F.upper("p_name").alias("name"))
    dim = part.where("item % 5 = 0")
    prefix = lambda c: longest_word_prefix(fold_accents(c), 7, 6)
    name = F.col("name")
    second = F.nullif(F.coalesce(F.get(F.split(name, " "), F.lit(1)), F.lit("")), F.lit(""))
    of = lambda value: dim.select(value.alias("value"), F.col("item").alias("id"))
    return k.ranked_match(part, "item", [(name, of(name), False), (first_word(name), of(second), False), (prefix(name), of(prefix(name)), False)])


@query("""WITH kb AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS name FROM part WHERE p_partkey % 20 = 0), items AS (SELECT p_partkey AS item, lower(p_name) AS value FROM part),
exact AS (SELECT item, min(id) AS id FROM items JOIN kb ON value = name GROUP BY item), sub AS (SELECT item, min(id) AS id FROM items JOIN kb ON contains(value, name) WHERE item NOT IN (SELECT item FROM exact) GROUP BY item)
SELECT items.item, coalesce(exact.id, sub.id) AS match FROM items LEFT JOIN exact USING (item) LEFT JOIN sub USING (item)""")
def jn12_resolve_pgx(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    kb = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.lower(first_word(F.col("p_name"))).alias("name"))
    items = part.select(F.col("p_partkey").alias("item"), F.lower("p_name").alias("value"))
    return k.inside_match(items, "item", "value", kb)


@query("""WITH dim AS (SELECT p_partkey AS id, upper(p_type || ' ' || p_size) AS key, [upper(p_name), upper(split_part(p_name, ' ', 1)) || p_size] AS inns FROM part WHERE p_partkey % 2 = 0), inn AS (SELECT DISTINCT id, unnest(inns) AS name FROM dim),
items AS (SELECT p_partkey AS item, upper(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || p_size WHEN 2 THEN split_part(p_name, ' ', 1) || p_size || ' x' ELSE 'none' END) AS generic, upper(CASE p_partkey % 8 WHEN 3 THEN p_type || ' ' || p_size ELSE p_name END) AS brand FROM part),
tried AS (SELECT item, 0 AS step, generic AS name FROM items UNION ALL SELECT item, 2, split_part(generic, ' ', 1) FROM items WHERE contains(generic, ' ')),
steps AS (SELECT item, step, id FROM tried JOIN inn USING (name) UNION ALL SELECT item, step + 1, id FROM tried JOIN dim ON key = name UNION ALL SELECT item, 4, id FROM items JOIN (SELECT name, min(id) AS id FROM inn GROUP BY name HAVING count(*) = 1) ON name = brand UNION ALL SELECT item, 5, id FROM items JOIN (SELECT key, min(id) AS id FROM dim GROUP BY key HAVING count(*) = 1) ON key = brand)
SELECT items.item, m.match, m.step FROM items LEFT JOIN (SELECT item, arg_min(id, (step, id)) AS match, min(step) AS step FROM steps GROUP BY item) m ON m.item = items.item""")
def jn09_resolve_names_cascade(spark: SparkSession, d: str) -> DataFrame:
    part, k4 = t(spark, d, "part"), F.col("p_partkey") % 4
    kind = F.concat_ws(" ", "p_type", "p_size")
    coined = F.concat(first_word(F.col("p_name")), "p_size")
    generic = F.when(k4 == 0, F.col("p_name")).when(k4 == 1, kind).when(k4 == 2, F.concat(coined, F.lit(" x"))).otherwise(F.lit("none"))
    items = part.select(F.col("p_partkey").alias("item"), generic.alias("generic"), F.when(F.col("p_partkey") % 8 == 3, kind).otherwise(F.col("p_name")).alias("brand"))
    return k.resolve_names(items, part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), kind.alias("key"), F.array("p_name", coined).alias("inns")))


@query("""WITH dim AS (SELECT s_suppkey AS id, [md5(s_name), md5(s_nationkey::VARCHAR)] AS inchis, 'C' || s_suppkey % 50 AS cas, 'U' || s_suppkey % 30 AS unii, ['UNII-V' || s_suppkey % 20, 'D' || s_suppkey % 40] AS synonyms, s_name AS label FROM supplier WHERE s_suppkey % 3 = 0),
items AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 7 = 0 THEN md5((p_partkey % 60)::VARCHAR) END AS inchi, CASE p_partkey % 5 WHEN 0 THEN 'C' || p_size WHEN 1 THEN 'D' || p_size END AS cas, CASE p_partkey % 3 WHEN 0 THEN 'U' || p_size WHEN 1 THEN 'V' || p_size END AS unii, p_name AS label, ['none', ' supplier#' || lpad((p_partkey % 1000)::VARCHAR, 9, '0')] AS synonyms FROM part),
steps AS (SELECT item, 0 AS step, id FROM items JOIN (SELECT id, unnest(inchis) AS v FROM dim) ON v = inchi UNION ALL SELECT item, 1, id FROM items JOIN (SELECT id, cas AS v FROM dim UNION ALL SELECT id, unnest(synonyms) FROM dim) ON v = cas
UNION ALL SELECT item, 2, id FROM items JOIN (SELECT id, unii AS v FROM dim UNION ALL SELECT id, substr(s, 6) FROM (SELECT id, unnest(synonyms) AS s FROM dim) WHERE starts_with(s, 'UNII-')) ON v = unii UNION ALL SELECT item, 3, id FROM (SELECT item, upper(trim(unnest(list_concat([label], synonyms)))) AS v FROM items) i JOIN dim ON upper(trim(dim.label)) = v)
SELECT items.item, m.match, m.step FROM items LEFT JOIN (SELECT item, arg_min(id, (step, id)) AS match, min(step) AS step FROM steps GROUP BY item) m ON m.item = items.item""")
def jn10_match_identity_cascade(spark: SparkSession, d: str) -> DataFrame:
    part, key = t(spark, d, "part"), F.col("p_partkey")
    of = lambda mark, c: F.concat(F.lit(mark), c)
    cas = F.when(key % 5 == 0, of("C", "p_size")).when(key % 5 == 1, of("D", "p_size"))
    unii = F.when(key % 3 == 0, of("U", "p_size")).when(key % 3 == 1, of("V", "p_size"))
    synonyms = F.array(F.lit("none"), of(" supplier#", F.lpad((key % 1000).cast("string"), 9, "0")))
    items = part.select(key.alias("item"), F.when(key % 7 == 0, F.md5((key % 60).cast("string"))).alias("inchi"), cas.alias("cas"), unii.alias("unii"), F.col("p_name").alias("label"), synonyms.alias("synonyms"))
    s = F.col("s_suppkey")
    dim = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(s.alias("id"), F.array(F.md5("s_name"), F.md5(F.col("s_nationkey").cast("string"))).alias("inchis"), of("C", s % 50).alias("cas"), of("U", s % 30).alias("unii"), F.array(of("UNII-V", s % 20), of("D", s % 40)).alias("synonyms"), F.col("s_name").alias("label"))
    return k.match_identity(items, dim)


@query(f"""WITH {MEDICINES}, substances AS (SELECT s_suppkey AS id, lower(s_name) AS label, 'leg' || s_suppkey % 25 AS legacy, ['syn ' || s_suppkey % 40, 'alt ' || s_suppkey] AS synonyms FROM supplier WHERE s_suppkey % 5 <> 0),
items AS (SELECT p_partkey AS item, CASE p_partkey % 6 WHEN 0 THEN 'LEG' || p_size WHEN 1 THEN p_name END AS medicine_id, CASE WHEN p_partkey % 6 < 5 THEN p_partkey END AS ref, CASE p_partkey % 12 WHEN 5 THEN 'Fine Suppliéres ' || p_size WHEN 11 THEN 'Supplier#' || lpad((p_partkey % 1000)::VARCHAR, 9, '0') ELSE p_name END AS label, p_size AS size FROM part),
linked AS (SELECT item, [p_name, 'Alt ' || size] AS inns, ['none', 'Syn ' || item % 50] AS labels, refs FROM items JOIN medicines ON ref = medicines.medicine_id WHERE item % 6 <> 3 UNION ALL SELECT item, [p_name], NULL, refs FROM items JOIN medicines ON ref = medicines.medicine_id WHERE item % 6 = 3),
asked AS (SELECT item, 0 AS path, 0 AS pos, lower(medicine_id) AS name FROM items UNION ALL SELECT item, 1, unnest(range(0, len(inns))), lower(unnest(inns)) FROM linked UNION ALL SELECT item, 2, unnest(range(0, len(labels))), lower(unnest(labels)) FROM linked UNION ALL SELECT item, 4, 0, lower(label) FROM items),
names AS (SELECT name, CASE WHEN length(l) >= 6 THEN substr(strip_accents(l), 1, 7) END AS prefix FROM (SELECT name, list_reduce(string_split(regexp_replace(name, '[^a-zA-ZÀ-ÿ\\s]', '', 'g'), ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS l FROM (SELECT DISTINCT name FROM asked WHERE name <> ''))),
hits AS (SELECT name, 0 AS step, id FROM names JOIN substances ON name = label UNION ALL SELECT name, 1, id FROM names JOIN substances ON name = legacy UNION ALL SELECT name, 2, id FROM names JOIN (SELECT id, unnest(synonyms) AS s FROM substances) ON s = name UNION ALL SELECT name, 3, min(id) FROM names JOIN substances ON contains(label, prefix) GROUP BY name),
steps AS (SELECT item, path, pos, step, id FROM asked JOIN hits USING (name) UNION ALL SELECT item, 3, pos, 0, ref FROM (SELECT item, unnest(range(0, len(refs))) AS pos, unnest(refs) AS ref FROM linked) WHERE ref IN (SELECT id FROM substances))
SELECT items.item, m.match, m.path, m.step FROM items LEFT JOIN (SELECT item, arg_min(id, (path, pos, step, id)) AS match, arg_min(path, (path, pos, step, id)) AS path, arg_min(step, (path, pos, step, id)) AS step FROM steps GROUP BY item) m ON m.item = items.item""")
def jn11_resolve_substance_cascade(spark: SparkSession, d: str) -> DataFrame:
    part, key, s = t(spark, d, "part"), F.col("p_partkey"), F.col("s_suppkey")
    of = lambda mark, c: F.concat(F.lit(mark), c)
    label = F.when(key % 12 == 5, of("Fine Suppliéres ", "p_size")).when(key % 12 == 11, of("Supplier#", F.lpad((key % 1000).cast("string"), 9, "0"))).otherwise(F.col("p_name"))
    items = part.select(key.alias("item"), F.when(key % 6 == 0, of("LEG", "p_size")).when(key % 6 == 1, F.col("p_name")).alias("medicine_id"), F.when(key % 6 < 5, key).alias("medicine_ref"), label.alias("label"))
    dim = t(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(s.alias("id"), F.col("s_name").alias("label"), of("leg", s % 25).alias("legacy"), F.array(of("syn ", s % 40), of("alt ", s)).alias("synonyms"))
    ref = F.col("medicine_id")
    sizes = part.select(key.alias("medicine_id"), "p_size")
    few = ref % 6 == 3
    meds = medicines(spark, d).join(sizes, "medicine_id").select(ref.alias("medicine_ref"), F.when(few, F.array("p_name")).otherwise(F.array("p_name", of("Alt ", "p_size"))).alias("inns"), F.when(~few, F.array(F.lit("none"), of("Syn ", ref % 50))).alias("labels"), "refs")
    return k.resolve_substance(items, dim, meds)


@query("""WITH kb AS (SELECT p_partkey AS id, lower(p_name) AS name, [lower(p_brand), lower(p_type)] AS synonyms FROM part WHERE p_partkey % 20 = 0), relations AS (SELECT 'rel ' || p_size AS drug_name, p_partkey AS id FROM part WHERE p_partkey % 10 = 0),
items AS (SELECT p_partkey AS item, lower(unnest([p_name || ' ' || p_size, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN p_brand WHEN 3 THEN 'Rel ' || p_size ELSE 'no' END, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END])) AS name FROM part),
names AS (SELECT DISTINCT name FROM items WHERE length(name) >= 3),
hits AS (SELECT name, 0 AS step, id FROM names JOIN kb USING (name) UNION ALL SELECT names.name, 1, min(id) FROM names JOIN kb ON contains(kb.name, names.name) GROUP BY ALL UNION ALL SELECT name, 2, min(id) FROM names JOIN (SELECT id, unnest(synonyms) AS s FROM kb) ON contains(s, name) GROUP BY ALL UNION ALL SELECT name, 3, id FROM names JOIN relations ON drug_name = name WHERE id IN (SELECT id FROM kb)),
ranked AS (SELECT item, step, id, (regexp_matches(name, '[ -]'), -length(name), name, step, id) AS r FROM items JOIN hits USING (name))
SELECT p_partkey AS item, m.match, m.step FROM part LEFT JOIN (SELECT item, arg_min(id, r) AS match, arg_min(step, r) AS step FROM ranked GROUP BY item) m ON m.item = p_partkey""")
def jn12_resolve_pgx_cascade(spark: SparkSession, d: str) -> DataFrame:
    part, key = t(spark, d, "part"), F.col("p_partkey")
    related = F.concat(F.lit("Rel "), "p_size")
    second = F.when(key % 5 == 0, F.col("p_name")).when(key % 5 == 1, first_word(F.col("p_name"))).when(key % 5 == 2, F.col("p_brand")).when(key % 5 == 3, related).otherwise(F.lit("no"))
    items = part.select(key.alias("item"), F.array(F.concat_ws(" ", "p_name", "p_size"), second, F.when(key % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("names"))
    kb = part.where("p_partkey % 20 = 0").select(key.alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("synonyms"))
    return k.resolve_pgx(items, kb, part.where("p_partkey % 10 = 0").select(related.alias("drug_name"), key.alias("id")))


@query("""WITH dim AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 = 0), items AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE substr(p_name, 1, 6) END AS value FROM part),
exact AS (SELECT item, min(id) AS id FROM items JOIN dim ON value = name GROUP BY item), pre AS (SELECT item, min(id) AS id FROM items JOIN dim ON starts_with(name, value) WHERE item NOT IN (SELECT item FROM exact) AND length(value) >= 3 GROUP BY item)
SELECT items.item, coalesce(exact.id, pre.id) AS match FROM items LEFT JOIN exact USING (item) LEFT JOIN pre USING (item)""")
def jn13_lookup_prefix(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    items = part.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.substring("p_name", 1, 6)).alias("value"))
    return k.prefix_match(items, "item", "value", part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE l_orderkey % 2 = 0 AND a.l_partkey <> b.l_partkey AND a.l_linenumber < b.l_linenumber),
b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT x.basket, x.item AS a, y.item AS b, CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = x.item AND dst = y.item) THEN x.item || '>' || y.item ELSE y.item || '>' || x.item END AS description FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item
WHERE EXISTS (SELECT 1 FROM e WHERE src = x.item AND dst = y.item) OR EXISTS (SELECT 1 FROM e WHERE src = y.item AND dst = x.item)""")
def jn14_pair_interactions(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem")
    even, odd = line.where("l_orderkey % 2 = 0"), line.where("l_orderkey % 2 = 1")
    a, b = even.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("i")), even.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("j"))
    edges = a.join(b, "l_orderkey").where("src <> dst and i < j").select("src", "dst", F.concat_ws(">", "src", "dst").alias("description")).distinct()
    return k.pair_interactions(odd.select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")), edges)


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item, l_suppkey % 10 AS attribute FROM lineitem)
SELECT a.basket, a.item AS a, b.item AS b, string_agg(a.attribute::VARCHAR, ',' ORDER BY a.attribute) AS common FROM x a JOIN x b ON a.basket = b.basket AND a.attribute = b.attribute AND a.item < b.item GROUP BY ALL""")
def jn15_shared_attribute_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 10).alias("attribute"))
    return k.shared_attribute_pairs(x).withColumn("common", F.array_join(F.col("common").cast("array<string>"), ","))


@query(f"WITH {MEDICINES} SELECT 'line' AS kind, count(*) AS n FROM lineitem WHERE l_partkey % 7 = 0 UNION ALL SELECT 'medicine', count(*) FROM medicines WHERE len(list_filter(refs, lambda x: x % 9 = 0)) > 0")
def jn16_orphans(spark: SparkSession, d: str) -> DataFrame:
    lines = k.orphans(t(spark, d, "lineitem"), "l_partkey", t(spark, d, "part").where("p_partkey % 7 <> 0"), "p_partkey")
    meds = k.array_orphans(medicines(spark, d), "medicine_id", "refs", substances(spark, d).where("substance_id % 9 <> 0"), "substance_id")
    return lines.agg(F.count("*").alias("n")).select(F.lit("line").alias("kind"), "n").union(meds.agg(F.count("*").alias("n")).select(F.lit("medicine").alias("kind"), "n"))


@query("SELECT c_custkey, (SELECT string_agg(o_orderstatus, ',' ORDER BY m) FROM (SELECT o_orderstatus, min(o_orderkey) AS m FROM orders WHERE o_custkey = c_custkey GROUP BY o_orderstatus)) AS history FROM customer")
def jn17_merge_history(spark: SparkSession, d: str) -> DataFrame:
    out = k.merge_history(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders"), "o_custkey", ["o_orderkey"], ["o_orderstatus"])
    return out.select("c_custkey", F.array_join(F.transform("history", lambda x: x["o_orderstatus"]), ",").alias("history"))


@query("SELECT user_id, event_id, p_name, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) ON p_partkey = event_id % 2000 WHERE event_type = 'purchase'")
def jn18_favourites(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import number_parts

    e = t(spark, d, "events").where("event_type = 'purchase'").withColumn("item", F.col("event_id") % 2000)
    part = t(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_name")
    joined = e.join(part, e["item"] == part["p_partkey"], "left")
    return number_parts(joined, ["user_id"], [F.desc("ts"), F.col("event_id")], "place", 1).select("user_id", "event_id", "p_name", "place")


@query("SELECT conv_id, turn, coalesce(c_name, 'anonymous') AS author FROM conversations LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = turn + 1")
def jn19_comments_with_author(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations")
    who = t(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    return c.join(who, c["turn"] + 1 == who["c_custkey"], "left").select("conv_id", "turn", F.coalesce("c_name", F.lit("anonymous")).alias("author"))


@query("SELECT p_partkey, upper(trim(split_part(p_name, ' ', 1))) IN (SELECT upper(trim(split_part(p_name, ' ', 2))) FROM part WHERE p_partkey % 50 = 0) AS known FROM part")
def jn20_membership_flags(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    names = part.where("p_partkey % 50 = 0").select(F.get(F.split("p_name", " "), F.lit(1)).alias("name"))
    return k.membership_flags(part.select("p_partkey", first_word(F.col("p_name")).alias("w")), "w", names, "name", "known").select("p_partkey", "known")


@query("""WITH old AS (SELECT p_brand AS key, list(DISTINCT p_size) AS m FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand), new AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'x' || p_brand ELSE p_brand END AS key, list(DISTINCT p_size) AS m FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT coalesce(old.key, new.key) AS key, array_to_string(list_sort(list_distinct(list_concat(coalesce(old.m, []), coalesce(new.m, [])))), ',') AS members FROM old FULL JOIN new ON old.key = new.key""")
def jn21_find_or_create(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    old = part.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("key")).agg(F.collect_set("p_size").alias("members"))
    new = part.where("p_partkey % 2 = 1").select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("x"), "p_brand")).otherwise(F.col("p_brand")).alias("key"), F.array("p_size").alias("members"))
    return k.find_or_create(old, new, "key", "members").select("key", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("""WITH steps AS (SELECT o.o_orderkey AS item, 0 AS step, c_custkey AS id FROM orders o JOIN customer ON o_custkey * 2 = c_custkey UNION ALL SELECT o_orderkey, 1, c_custkey FROM orders JOIN customer ON o_custkey + 7 = c_custkey AND c_custkey % 2 = 0 UNION ALL SELECT o_orderkey, 2, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT item, arg_min(id, (step, id)) AS match, min(step) AS step FROM steps GROUP BY item""")
def jn22_lookup_alt_keys(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("value"), F.col("c_custkey").alias("id"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey")
    return k.ranked_match(o, "item", [(F.col("o_custkey") * 2, c, False), (F.col("o_custkey") + 7, c.where("id % 2 = 0"), False), (F.col("o_custkey"), c, False)])


@query(f"WITH {MEDICINES}, counts AS (SELECT s AS substance_id, count(*) AS n FROM (SELECT unnest(refs) AS s FROM medicines) GROUP BY s ORDER BY n DESC, s LIMIT 30) SELECT substance_id, n, coalesce(s_name, '(unknown)') AS label FROM counts LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = substance_id")
def jn23_topk_with_label(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.aggregates import top_linked

    return top_linked(medicines(spark, d), "refs", substances(spark, d).where("substance_id % 4 <> 0"), "substance_id", "label", 30, "(unknown)")


@query(f"""WITH {MEDICINES}, m AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_partkey AS ref FROM lineitem)
SELECT 'REFERS_TO' AS kind, id AS src, 'medicine:' || ref AS dst FROM m WHERE ref % 7 <> 0 UNION SELECT 'HAS_SUBSTANCE', medicine_key, 'substance:' || s FROM (SELECT medicine_id, medicine_key, unnest(refs) AS s FROM medicines) WHERE medicine_id % 7 <> 0 AND s % 5 <> 0""")
def jn24_build_graph(spark: SparkSession, d: str) -> DataFrame:
    m, med, sub = market(spark, d, "market_id", "medicine_ref"), medicines(spark, d).where("medicine_id % 7 <> 0"), substances(spark, d).where("substance_id % 5 <> 0")
    nodes = lambda df, label, key, name: k.graph_nodes([df.select(F.lit(label).alias("label"), key.alias("key"), F.col(name).alias("name"))])
    products = nodes(m, "MarketProduct", F.col("market_id"), "market_id")  # edges need no titles, which would join all lines with their parts
    meds = nodes(med, "Medicine", F.col("medicine_key"), "p_name")
    subs = nodes(sub, "Substance", F.concat(F.lit("substance:"), "substance_id"), "label")
    one = k.graph_edges("REFERS_TO", m.withColumn("to", F.concat(F.lit("medicine:"), "medicine_ref")), "market_id", "to", products, meds)
    items = med.select("medicine_key", F.explode("refs").alias("s")).withColumn("to", F.concat(F.lit("substance:"), "s"))
    return one.union(k.graph_edges("HAS_SUBSTANCE", items, "medicine_key", "to", meds, subs))
