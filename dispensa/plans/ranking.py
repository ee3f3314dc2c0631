"""Queries over pages, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as r
from ..operators import sets
from ..operators.projections import priority_cols
from .registry import query
from .views import MARKET, MEDICINES, market, medicines, substances, t


@query(f"WITH {MARKET} SELECT market_id, CASE WHEN country = 'FRANCE' AND has_doc THEN 1 WHEN country = 'FRANCE' THEN 2 WHEN has_doc THEN 3 ELSE 4 END AS priority FROM market WHERE contains(lower(brand_title), 'a') ORDER BY priority, brand_title, market_id LIMIT 25 OFFSET 50")
def so01_page(spark: SparkSession, d: str) -> DataFrame:
    m = priority_cols(market(spark, d).where(F.contains(F.lower("brand_title"), F.lit("a"))), "a", "FRANCE", "brand_title", "country", "has_doc")
    return r.page(m, ["priority", "brand_title", "market_id"], 3, 25).select("market_id", "priority")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY CASE WHEN l_linenumber > 1 THEN l_shipdate END ASC NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100 OFFSET 100")
def so02_page_by_date(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem").withColumn("day", F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")))
    return r.page(line, ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 2, 1000).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15")
def so03_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return r.latest_n(t(spark, d, "orders"), "o_orderdate", "o_orderkey", 15).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE strftime(o_orderdate, '%Y%m%d')::INT END AS day FROM orders")
def so04_french_date_key(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t(spark, d, "orders").select("o_orderkey", r.french_date_key(text).alias("day"))


@query("SELECT l_orderkey, string_agg(a || '.' || b, ',' ORDER BY a, b) AS codes FROM (SELECT DISTINCT l_orderkey, l_linenumber AS a, l_quantity::INT AS b FROM lineitem) GROUP BY l_orderkey")
def so05_sort_section_codes(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws(".", "l_linenumber", F.col("l_quantity").cast("int"))).alias("c"))
    return x.select("l_orderkey", F.array_join(r.sort_section_codes(F.col("c")), ",").alias("codes"))


@query("SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages, count(*) > 60 AS has_more FROM part WHERE p_size > 10")
def so06_page_info(spark: SparkSession, d: str) -> DataFrame:
    return r.page_info(t(spark, d, "part").where("p_size > 10"), 3, 20)


@query("""WITH one AS (SELECT DISTINCT s_name AS label FROM supplier WHERE s_suppkey % 3 = 0 AND contains(lower(s_name), '1') AND contains(lower(s_name), 'er') ORDER BY 1 LIMIT 15), two AS (SELECT DISTINCT s_name AS label FROM supplier WHERE s_suppkey % 2 = 0 AND contains(lower(s_name), 'er') ORDER BY 1 LIMIT 10)
SELECT kind, label FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY rank, label) AS k FROM (SELECT 0 AS rank, 'entity' AS kind, label FROM one UNION ALL SELECT 1, 'brand', label FROM two)) WHERE k = 1 ORDER BY rank, label LIMIT 20""")
def so07_typeahead(spark: SparkSession, d: str) -> DataFrame:
    s = substances(spark, d).withColumn("external_id", F.when(F.col("substance_id") % 3 == 0, F.col("substance_id")))
    return r.typeahead("ER", s.where(F.col("label").contains("1")), s.where("substance_id % 2 = 0"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def so08_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))  # one row
    return r.vector_topk(e.join(F.broadcast(q), F.lit(True)), "vec_id", "embedding", F.col("q"), 10)


@query("SELECT p_partkey AS id FROM part WHERE p_size < 10 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def se01_union_ids(spark: SparkSession, d: str) -> DataFrame:
    return sets.union_ids(t(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")), t(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query(f"WITH {MEDICINES} SELECT a.medicine_id, array_to_string(list_sort(list_intersect(a.refs, b.refs)), ',') AS common FROM medicines a JOIN medicines b ON b.medicine_id = a.medicine_id + 1")
def se02_intersect_sets(spark: SparkSession, d: str) -> DataFrame:
    m = medicines(spark, d)
    b = m.select((F.col("medicine_id") - 1).alias("medicine_id"), F.col("refs").alias("other"))
    return m.join(b, "medicine_id").select("medicine_id", F.array_join(sets.intersect_sets(F.col("refs"), F.col("other")).cast("array<string>"), ",").alias("common"))


@query(f"WITH {MEDICINES} SELECT medicine_id FROM medicines WHERE len(list_filter(refs, lambda x: x % 9 = 0)) > 0")
def se03_changed_only(spark: SparkSession, d: str) -> DataFrame:
    m = medicines(spark, d)
    new = F.when(F.size(F.filter("refs", lambda x: x % 9 != 0)) > 0, F.reverse(F.filter("refs", lambda x: x % 9 != 0)))
    return m.where(sets.changed(F.col("refs"), new)).select("medicine_id")


@query("SELECT p_partkey, p_brand || CASE WHEN p_type <> p_brand THEN ',' || p_type ELSE '' END || CASE WHEN p_name NOT IN (p_brand, p_type) THEN ',' || p_name ELSE '' END AS merged FROM part")
def se04_merge_lists(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", F.array_join(sets.merge_lists(F.array("p_brand", "p_type"), F.array("p_type", "p_name", "p_brand")), ",").alias("merged"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def se05_except_keys(spark: SparkSession, d: str) -> DataFrame:
    return sets.except_keys(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_totalprice > 200000"), "c_custkey", "o_custkey")
