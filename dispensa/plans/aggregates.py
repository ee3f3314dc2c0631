"""Queries over aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import links
from ..operators import windows as w
from ..operators.filters import shape_counts
from ..operators.sets import changed
from ..sources.writers import observed
from ..streaming.jobs import work_dir
from .registry import query
from .views import MARKET, MEDICINES, market, medicines, substances, t

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "embeddings")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _TABLES))
def ag01_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.table_counts({n: t(spark, d, n) for n in _TABLES})


@query("SELECT count(DISTINCT nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, '')) AS n FROM part")
def ag02_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return a.distinct_count(t(spark, d, "part").withColumn("x", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))), "x")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def ag03_top_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.top_counts(t(spark, d, "part"), "p_type", 10)


@query(f"WITH {MEDICINES}, c AS (SELECT s AS substance_id, count(*) AS n FROM (SELECT unnest(refs) AS s FROM medicines) GROUP BY s ORDER BY n DESC, s LIMIT 20) SELECT substance_id, n, coalesce(s_name, '(unknown)') AS label FROM c LEFT JOIN supplier ON s_suppkey = substance_id")
def ag04_top_linked(spark: SparkSession, d: str) -> DataFrame:
    return a.top_linked(medicines(spark, d), "refs", substances(spark, d), "substance_id", "label", 20)


@query("SELECT split_part(o_orderpriority, '-', 1) AS part, count(*) AS n FROM orders GROUP BY 1")
def ag05_count_by_key_part(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.concat_ws("|", "o_orderstatus", F.split("o_orderpriority", "-")[0], "o_orderkey").alias("key"))
    return a.count_by_key_part(o, "key", 1)


@query("SELECT count(*) FILTER (value >= 20) AS pk, count(*) FILTER (value < 5) AS pd, count(*) FILTER (event_type = 'error') AS errors FROM events")
def ag06_cond_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.cond_counts(t(spark, d, "events"), pk=F.col("value") >= 20, pd=F.col("value") < 5, errors=F.col("event_type") == "error")


@query("SELECT 'secure' AS label, count(*) FILTER (url LIKE 'https%') AS n FROM pages UNION ALL SELECT 'query', count(*) FILTER (contains(url, '?')) FROM pages UNION ALL SELECT 'none', 0 UNION ALL SELECT 'fragment', count(*) FILTER (contains(url, '#')) FROM pages")
def ag07_count_labels(spark: SparkSession, d: str) -> DataFrame:
    return a.count_labels(t(spark, d, "pages").select(F.array("url").alias("urls")), "urls", {"secure": "^https", "query": r"\?", "fragment": "#", "none": "^zzz"})


@query("SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part WHERE p_size >= 10 GROUP BY p_size")
def ag08_facets(spark: SparkSession, d: str) -> DataFrame:
    return a.facets(t(spark, d, "part"), ["p_brand", "p_type", "p_size"], 2)


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS items FROM orders GROUP BY o_custkey")
def ag09_group_sorted(spark: SparkSession, d: str) -> DataFrame:
    out = a.group_sorted(t(spark, d, "orders"), "o_custkey", [F.col("o_orderpriority"), -F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")], ["o_orderkey"])
    return out.select("o_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("items"))


@query("SELECT l_orderkey, coalesce((SELECT string_agg(k, ',' ORDER BY m) FROM (SELECT l_linestatus || l_quantity::INT AS k, min((l_linenumber, l_partkey, l_suppkey)) AS m FROM lineitem i WHERE i.l_orderkey = o.l_orderkey AND l_returnflag = 'A' GROUP BY 1)), '') AS labels FROM (SELECT DISTINCT l_orderkey FROM lineitem) o")
def ag10_ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem").withColumn("v", F.concat("l_linestatus", F.col("l_quantity").cast("int")))
    return a.ordered_unique(line, "l_orderkey", "v", F.col("l_returnflag") == "A", ["l_linenumber", "l_partkey", "l_suppkey"]).withColumn("labels", F.array_join("labels", ","))


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS latest, count(*) FILTER (o_orderstatus = 'F') > 0 AS has_any FROM orders GROUP BY o_custkey")
def ag11_latest_by(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumn("day", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return a.latest_by(o, "o_custkey", "day", "o_orderkey", "o_orderpriority")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value >= 20) AS pk, count(*) FILTER (value < 5) AS pd, min(event_id) AS first_event FROM events WHERE event_type <> 'view' GROUP BY event_type")
def ag12_rollup_nested(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("gene", F.nullif("event_type", F.lit("view"))).withColumn("bucket", F.pmod(F.col("event_id"), F.lit(64)))
    # Lists are nested per gene and bucket of drugs, so that a hot gene has no unbounded list.
    fine = a.rollup_nested(e.withColumn("key", F.concat_ws("|", F.when(F.col("gene").isNotNull(), F.col("gene")), "bucket")).where("gene is not null"), "key", ["event_id"], ["user_id"], pk=F.col("value") >= 20, pd=F.col("value") < 5)
    return fine.groupBy(F.split("key", r"\|")[0].alias("event_type")).agg(F.sum("n").alias("n"), F.sum("pk").alias("pk"), F.sum("pd").alias("pd"), F.min(F.col("items")[0]["event_id"]).alias("first_event"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value >= 20) AS pk, count(*) FILTER (value < 5) AS pd, count(*) AS nested, sum(event_id)::BIGINT AS ids, count(*) > 100 AS several, true AS bounded FROM events GROUP BY event_type")
def ag12_rollup_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every type of event with its lists of at most 100 events."""
    e = t(spark, d, "events")
    parts = a.rollup_parts(e, "event_type", ["event_id"], ["user_id"], 100, pk=F.col("value") >= 20, pd=F.col("value") < 5)
    total = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["event_id"])
    return parts.groupBy("event_type", "n", "pk", "pd").agg(F.sum(F.size("items")).alias("nested"), F.sum(total).alias("ids"), (F.countDistinct("part") > 1).alias("several"), (F.max(F.size("items")) <= 100).alias("bounded"))


@query(f"WITH {MEDICINES} SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM lineitem WHERE l_partkey % 7 = 0) AS orphan_lines, (SELECT count(*) FROM medicines WHERE len(list_filter(refs, lambda x: x % 9 = 0)) > 0) AS orphan_medicines, (SELECT count(*) FROM medicines WHERE medicine_id % 5 = 0) AS missing, 0 AS wrong_type")
def ag13_integrity_report(spark: SparkSession, d: str) -> DataFrame:
    line, med = t(spark, d, "lineitem"), medicines(spark, d)
    n = line.agg(F.count("*").alias("lines"))
    o = links.orphans(line, "l_partkey", t(spark, d, "part").where("p_partkey % 7 <> 0"), "p_partkey").agg(F.count("*").alias("orphan_lines"))
    m = links.array_orphans(med, "medicine_id", "refs", substances(spark, d).where("substance_id % 9 <> 0"), "substance_id").agg(F.count("*").alias("orphan_medicines"))
    s = shape_counts(med.withColumn("refs", F.when(F.col("medicine_id") % 5 != 0, F.col("refs").cast("array<string>"))), "refs").select("missing", "wrong_type")
    one = lambda x, y: x.join(y, F.lit(True))  # noqa: E731  frames of one row each
    return one(one(one(n, o), m), s)


@query("SELECT 'account' AS source, count(*) FILTER (c_acctbal > 0) AS n FROM customer UNION ALL SELECT 'nation', count(*) FILTER (c_nationkey % 2 = 0) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (c_custkey % 3 = 0) FROM customer")
def ag14_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, 1).alias("account"), F.when(F.col("c_nationkey") % 2 == 0, 1).alias("nation"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("segment"))
    return a.coverage(c, ["account", "nation", "segment"])


@query(f"""WITH {MARKET}, {MEDICINES}, s AS (SELECT medicine_id, bool_or(x % 4 = 0) AS src, bool_or(x % 6 = 0) AS nam FROM (SELECT medicine_id, unnest(refs) AS x FROM medicines) GROUP BY medicine_id), tags AS (SELECT market_id, list_filter([CASE WHEN has_doc THEN 'doc' END, CASE WHEN nam THEN 'known' END, CASE WHEN src THEN 'substance' END], lambda x: x IS NOT NULL) AS tags FROM market JOIN s ON medicine_id = medicine_ref)
SELECT tag, count(*) AS n FROM (SELECT market_id, unnest(tags) AS tag FROM tags WHERE array_to_string(tags, ',') <> 'substance') GROUP BY tag""")
def ag15_compute_sources(spark: SparkSession, d: str) -> DataFrame:
    sub = substances(spark, d).withColumn("source", F.when(F.col("substance_id") % 4 == 0, F.lit("x")))
    names = substances(spark, d).where("substance_id % 6 = 0").select(F.lower("label").alias("name"))
    tags = a.compute_sources(market(spark, d, "market_id", "medicine_ref", "has_doc"), medicines(spark, d), sub, names)
    new = tags.where(changed(F.array(F.lit("substance")), F.col("tags")))
    return new.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS as_set, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS as_list FROM orders GROUP BY o_custkey")
def ag16_set_append(spark: SparkSession, d: str) -> DataFrame:
    return a.set_append(t(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_custkey", F.array_join("as_set", "").alias("as_set"), F.array_join("as_list", "").alias("as_list"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity % 5 = 0) + count(DISTINCT CASE WHEN l_quantity % 5 <> 0 THEN l_partkey % 3 END) AS kept FROM lineitem GROUP BY l_orderkey")
def ag17_dedup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("items"))
    h = lambda i: F.when(i["l_quantity"] % 5 != 0, F.md5((i["l_partkey"] % 3).cast("string")))
    return x.select("l_orderkey", F.size(a.dedup_by_hash(F.col("items"), h)).cast("long").alias("kept"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS ids, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def ag18_distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    return a.distinct_ids(t(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT count(*) AS scanned, count(*) FILTER (c_custkey % 7 <> 0) AS matched, count(*) FILTER (c_custkey % 7 = 0) AS orphan, 0 AS errors FROM customer")
def ag19_job_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = links.rewrite_fk(t(spark, d, "customer").withColumn("ref", F.col("c_custkey")), "ref", t(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey"), "c_custkey", "c_custkey")
    rows, seen = observed(m, "links", scanned=F.lit(True), matched=F.col("matched"), orphan=~F.col("matched"), errors=F.lit(False))
    rows.write.parquet(work_dir(spark))
    return spark.createDataFrame([tuple(seen.get.values())], "scanned long, matched long, orphan long, errors long")


@query("SELECT l_orderkey, l_returnflag, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) WHERE r <= 3 GROUP BY ALL")
def ag20_chunks_by_kind(spark: SparkSession, d: str) -> DataFrame:
    ids = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = a.chunks_by_kind(ids, t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", 3)
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def wn01_first_ranked(spark: SparkSession, d: str) -> DataFrame:
    return w.first_ranked(t(spark, d, "part"), "p_brand", ["p_size", "p_partkey"]).select("p_brand", "p_partkey")


@query("SELECT l_orderkey || '|' || l_returnflag || '|' || lpad((row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::VARCHAR, 4, '0') AS id, l_partkey FROM lineitem")
def wn02_number_parts(spark: SparkSession, d: str) -> DataFrame:
    n = w.number_parts(t(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return n.select(F.concat_ws("|", "l_orderkey", "l_returnflag", F.lpad(F.col("no").cast("string"), 4, "0")).alias("id"), "l_partkey")


_LINES = "lines AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"


def _lines(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"WITH {_LINES} SELECT doc_id, pos, last_value(CASE WHEN pos % 4 = 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS header FROM lines")
def wn03_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return w.carry_forward(_lines(spark, d), "doc_id", "pos", F.when(F.col("pos") % 4 == 1, F.col("pos")), "header").select("doc_id", "pos", "header")


@query(f"WITH {_LINES}, m AS (SELECT *, min(CASE WHEN contains(line, 'ing') THEN pos END) OVER (PARTITION BY doc_id) AS s FROM lines), e AS (SELECT *, min(CASE WHEN contains(line, 'th') AND pos > s THEN pos END) OVER (PARTITION BY doc_id) AS e FROM m) SELECT doc_id, pos FROM e WHERE CASE WHEN s IS NOT NULL THEN pos > s AND (e IS NULL OR pos < e) ELSE trim(line) <> '' END")
def wn04_between_markers(spark: SparkSession, d: str) -> DataFrame:
    return w.between_markers(_lines(spark, d), "doc_id", "pos", "line", F.col("line").contains("ing"), F.col("line").contains("th")).select("doc_id", "pos")


@query(f"WITH {_LINES} SELECT doc_id % 50 AS place, lang AS term, sum(length(line))::BIGINT AS n, arg_min(md5(line), doc_id * 100000 + pos) AS text, min(pos % 3) AS priority FROM lines JOIN documents USING (doc_id) GROUP BY 1, 2")
def wn05_first_and_sum(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return w.first_and_sum(x.select((F.col("doc_id") % 50).alias("place"), F.col("lang").alias("term"), (F.col("doc_id") * 100000 + F.col("pos")).alias("pos"), F.length("line").alias("n"), F.md5("line").alias("text"), (F.col("pos") % 3).alias("priority")))


@query("SELECT p_partkey, p_name FROM part WHERE p_name || p_brand IN (SELECT p_name || p_brand FROM part GROUP BY p_name || p_brand HAVING count(*) = 1)")
def wn06_unique_only(spark: SparkSession, d: str) -> DataFrame:
    return w.unique_only(t(spark, d, "part").withColumn("k", F.concat("p_name", "p_brand")), "k").select("p_partkey", "p_name")
