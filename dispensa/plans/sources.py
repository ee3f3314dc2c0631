"""Queries over sources and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables, writers
from ..streaming.jobs import work_dir
from .registry import oracle_sql_of, query
from .views import t


@query("""SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS code, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y%m%d')::INT END AS day, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0""")
def src01_scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    key = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("2020")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = tables.split_tsv(o.select(F.concat_ws("\t", key, day, "o_orderstatus").alias("line")), "line", ["code", "day", "status"])
    return rows.select("code", tables.ymd_or_null(F.col("day")).alias("day"), "status")


@query("""SELECT lpad(l_orderkey::VARCHAR, 8, '0') AS code, 'L' || l_suppkey AS label, 'un tube' AS reference, CASE WHEN l_returnflag = 'A' THEN 'SA' ELSE 'FT' END AS kind, l_linenumber AS rank FROM lineitem WHERE l_linenumber <> 7""")
def src02_repair_ragged(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    parts = [F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("gel"), F.col("l_partkey").cast("string"), F.concat(F.lit("L"), F.col("l_suppkey")), F.lit("5 mg"), F.when(n % 3 == 0, F.lit("un\ttube")).otherwise(F.lit("un tube")), F.when(n == 7, F.lit("??")).when(F.col("l_returnflag") == "A", F.lit("SA")).otherwise(F.lit("FT")), n.cast("string"), F.when(n % 2 == 0, F.lit(""))]
    return tables.repair_ragged(t(spark, d, "lineitem").select(F.concat_ws("\t", *parts).alias("line"))).select("code", "label", "reference", "kind", "rank")


@query("SELECT DISTINCT lpad(o_custkey::VARCHAR, 8, '0') AS code FROM orders WHERE o_custkey % 11 <> 0")
def src03_scan_codes(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("o_custkey") % 11 == 0, F.lit("12 34")).otherwise(F.concat(F.lit(" "), F.lpad(F.col("o_custkey").cast("string"), 8, "0")))
    return tables.scan_codes(t(spark, d, "orders").select(key.alias("raw")), "raw")


@query("SELECT DISTINCT trim(split_part(url, '#', 1)) AS url FROM pages WHERE trim(split_part(url, '#', 1)) <> ''")
def src04_url_worklist(spark: SparkSession, d: str) -> DataFrame:
    return tables.url_worklist(t(spark, d, "pages"), "url")


@query("SELECT 'D' || p_partkey AS drug_id, 'D' || p_partkey || ',O' || p_partkey AS all_ids, p_name AS name, p_brand || CASE WHEN lower(p_type) <> lower(p_brand) THEN ',' || p_type ELSE '' END AS synonyms, 'X' || p_size AS atc_codes, p_size::VARCHAR AS cas FROM part")
def src05_scan_drug_xml(spark: SparkSession, d: str) -> DataFrame:
    """Parts are landed as drug records, then scanned."""
    known = lambda value, primary: F.struct(value.alias("_VALUE"), F.lit(primary).alias("_primary"))
    size = F.col("p_size").cast("string")
    records = t(spark, d, "part").select(
        F.array(known(F.concat(F.lit("D"), "p_partkey"), "true"), known(F.concat(F.lit("O"), "p_partkey"), "false")).alias("drugbank-id"),
        F.col("p_name").alias("name"),
        F.struct(F.array("p_brand", "p_type", F.upper("p_brand")).alias("synonym")).alias("synonyms"),
        F.struct(F.array(F.struct(F.concat(F.lit("X"), size).alias("_code")), F.struct(F.concat(F.lit("X"), size).alias("_code"))).alias("atc-code")).alias("atc-codes"),
        F.struct(F.array(F.struct(F.lit("CAS number").alias("resource"), size.alias("identifier"))).alias("external-identifier")).alias("external-identifiers"),
    )
    path = work_dir(spark)
    records.write.format("xml").option("rowTag", "drug").option("rootTag", "drugbank").save(path)
    out = tables.scan_drug_xml(spark, path)
    joined = {c: F.array_join(c, ",").alias(c) for c in ("all_ids", "synonyms", "atc_codes")}
    return out.select("drug_id", joined["all_ids"], "name", joined["synonyms"], joined["atc_codes"], "cas")


@query("SELECT o_orderkey, l_partkey AS package_code, l_linenumber AS package_no FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 3")
def src06_explode_packages(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("code"), F.col("l_linenumber").alias("no"))).alias("packaging"))
    o = t(spark, d, "orders")
    records = o.join(line, o["o_orderkey"] == line["l_orderkey"], "left").select("o_orderkey", "packaging")
    return tables.explode_packages(records, "packaging", "code").select("o_orderkey", F.col("package.code").alias("package_code"), F.col("package.no").alias("package_no"))


def _bracket(batches):
    """The records of a task as the lines of one JSON array."""
    lead = "["
    for batch in batches:
        for record in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"value": [lead + record]})
            lead = ","
    yield pa.RecordBatch.from_pydict({"value": ["[]" if lead == "[" else "]"]})


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def src07_import_json_array(spark: SparkSession, d: str) -> DataFrame:
    """Customers are landed as JSON arrays with exported object ids, an array for each task, then imported."""
    c = t(spark, d, "customer").select(F.struct(F.lpad(F.hex("c_custkey"), 24, "0").alias("$oid")).alias("_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))

    path = work_dir(spark)
    c.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_bracket, "value string").write.text(path)
    return tables.import_json_array(spark, path)


@query("SELECT s_suppkey::VARCHAR AS document, sha256(s_name || chr(10)) AS sha256, length(s_name) + 1 AS length FROM supplier")
def src09_scan_binary_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers are landed as files with the ending .pdf, each in a numbered folder, then scanned."""
    path, tasks = work_dir(spark), 4 * spark.sparkContext.defaultParallelism
    writers.land_files(t(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", path, "pdf", tasks)
    return tables.scan_binary_corpus(spark, path, tasks).select("document", "sha256", "length")


@query("SELECT conv_id || '/' || turn AS url, CASE WHEN turn % 2 = 0 THEN 3 ELSE 2 END AS schema_version, text AS body FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def src08_import_envelopes(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select(F.when(F.col("role") == "user", F.lit("success")).otherwise(F.lit("failed")).alias("status"), F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("body"))).alias("data"), F.concat_ws("/", "conv_id", "turn").alias("url"), F.when(F.col("turn") % 2 == 0, F.lit(3)).alias("version"))
    return tables.import_envelopes(c, "status", "data", "url", "version").select("url", "schema_version", F.col("data.body").alias("body"))


@query("""SELECT 'meta/' || conv_id || '/' || turn AS url, CASE WHEN turn % 4 = 1 THEN 'own/' ELSE 'meta/' END || conv_id || '/' || turn AS own_url, CASE turn % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE 'v4' END AS schema_version, CASE WHEN turn % 2 = 0 THEN '{"n":' || turn || '}' ELSE '{}' END AS source, text AS body FROM conversations WHERE role = 'user' AND text IS NOT NULL AND turn % 5 <> 4""")
def src08_import_envelope_files(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are landed as files of envelopes whose members are of mixed types: some failed, some have data that is no object, some have no address."""
    turn, no = F.col("turn"), F.concat_ws("/", "conv_id", "turn")
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")  # noqa: E731  as JSON
    own = F.when(turn % 4 == 1, F.concat(F.lit('"url": '), text(F.concat(F.lit("own/"), no)), F.lit(", "))).otherwise(F.lit('"url": "", '))
    meta = F.when(turn % 5 == 4, F.lit('"metadata": "none"')).otherwise(F.concat(F.lit('"metadata": {"url": '), text(F.concat(F.lit("meta/"), no)), F.lit("}")))
    version = F.when(turn % 3 == 1, F.lit(', "schema_version": 3')).when(turn % 3 == 2, F.lit(', "schema_version": "v4"')).otherwise(F.lit(""))
    source = F.when(turn % 2 == 0, F.concat(F.lit(', "source": {"n": '), turn.cast("string"), F.lit("}"))).otherwise(F.lit(', "source": [1]'))
    data = F.when(F.col("text").isNull(), F.lit("7")).otherwise(F.concat(F.lit("{"), own, meta, version, source, F.lit(', "body": '), text(F.col("text")), F.lit("}")))
    status = F.when(F.col("role") == "user", F.lit('"success"')).otherwise(F.lit("false"))
    path = work_dir(spark)
    t(spark, d, "conversations").select(F.concat(F.lit('{"status": '), status, F.lit(', "data": '), data, F.lit("}")).alias("value")).mapInArrow(_bracket, "value string").write.text(path)
    found = tables.import_envelope_files(spark, f"{path}/*.txt")
    return found.select("url", "own_url", "schema_version", "source", F.expr("variant_get(data, '$.body', 'string')").alias("body"))


_UPDATES = "updates AS (SELECT o_custkey + 0 AS id, max(o_orderkey) AS seg FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey UNION ALL SELECT 1000000 + n_nationkey, n_nationkey FROM nation)"


def _customer_updates(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).cast("long").alias("seg"), F.lit("old").alias("created"))
    o = t(spark, d, "orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("seg"))
    extra = t(spark, d, "nation").select((F.col("n_nationkey") + 1000000).cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("seg"))
    return c, o.unionByName(extra).withColumn("created", F.lit("new"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def snk05_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return spark.read.schema(rows.schema).parquet(writers.snapshot(rows, work_dir(spark), "20240101"))


@query(f"WITH {_UPDATES} SELECT coalesce(c_custkey, id) AS id, c_name AS name, coalesce(seg, 0) AS seg FROM customer FULL JOIN updates ON c_custkey = id")
def snk01_upsert(spark: SparkSession, d: str) -> DataFrame:
    c, u = _customer_updates(spark, d)
    return writers.upsert(c.drop("created"), u.drop("created"), ["id"])


@query(f"WITH {_UPDATES} SELECT coalesce(c_custkey, id) AS id, c_name AS name, coalesce(seg, 0) AS seg, CASE WHEN c_custkey IS NULL THEN 'new' ELSE 'old' END AS created FROM customer FULL JOIN updates ON c_custkey = id")
def snk02_upsert_insert_only(spark: SparkSession, d: str) -> DataFrame:
    c, u = _customer_updates(spark, d)
    return writers.upsert(c, u, ["id"], ("created",))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_mktsegment END AS segment, c_nationkey AS nation, 'v3' AS version FROM customer")
def snk03_fill_defaults(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("version")).alias("s"))
    return writers.fill_defaults(c, "s", {"segment": "none", "version": "v3"}).select("c_custkey", "s.segment", "s.nation", "s.version")


@query("SELECT c_custkey, c_name AS name, n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey")
def snk04_enrich_branch(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.lit(-1).cast("long").alias("n")).alias("orders")).alias("doc"))
    o = t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = c.join(o, c["c_custkey"] == o["o_custkey"], "left")
    return writers.enrich_branch(joined, "doc", "orders", F.when(F.col("n").isNotNull(), F.struct("n"))).select("c_custkey", "doc.name", F.col("doc.orders.n").alias("orders"))


@query("WITH new AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS no FROM lineitem WHERE l_orderkey % 10 = 0 AND l_quantity > 20) SELECT l_orderkey, l_partkey, l_linenumber AS no FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new")
def snk06_replace_keys(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import number_parts

    line = t(spark, d, "lineitem")
    new = number_parts(line.where("l_orderkey % 10 = 0 and l_quantity > 20"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "no", 1)
    return writers.replace_keys(line.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("no")), new.select("l_orderkey", "l_partkey", "no"), "l_orderkey")


@query("""WITH RECURSIVE items AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_quantity::BIGINT AS size FROM lineitem),
bins AS (SELECT k, i, 0 AS chunk, size AS used, size FROM items WHERE i = 1 UNION ALL SELECT n.k, n.i, CASE WHEN b.used > 0 AND b.used + n.size > 60 THEN b.chunk + 1 ELSE b.chunk END, CASE WHEN b.used > 0 AND b.used + n.size > 60 THEN n.size ELSE b.used + n.size END, n.size FROM bins b JOIN items n ON n.k = b.k AND n.i = b.i + 1)
SELECT k AS l_orderkey, chunk, count(*) AS n_items, sum(size)::BIGINT AS bytes FROM bins GROUP BY k, chunk""")
def snk07_chunk_by_size(spark: SparkSession, d: str) -> DataFrame:
    items = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size")))).alias("items"))
    return writers.chunk_by_size(items, ["l_orderkey"], "items", "size", 60)


@query("SELECT 'r1' AS run_id, 'finished' AS status, count(*) AS processed, count(*) FILTER (o_orderstatus = 'F') AS written, count(*) FILTER (o_orderstatus <> 'F') AS errors FROM orders")  # times differ from run to run
def snk08_run_ledger(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    return writers.run_ledger(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "r1", F.col("o_orderstatus") == "F", lambda x: x.write.parquet(path)).drop("started_at", "finished_at")


@query("SELECT substr(md5(vec_id::VARCHAR), 1, 8) || '-' || substr(md5(vec_id::VARCHAR), 9, 4) || '-' || substr(md5(vec_id::VARCHAR), 13, 4) || '-' || substr(md5(vec_id::VARCHAR), 17, 4) || '-' || substr(md5(vec_id::VARCHAR), 21, 12) AS id, len(embedding) AS size, vec_id, label FROM embeddings")
def snk09_export_vectors(spark: SparkSession, d: str) -> DataFrame:
    return writers.export_vectors(t(spark, d, "embeddings"), "vec_id", "embedding", ["vec_id", "label"]).select("id", F.size("vector").cast("long").alias("size"), "payload.vec_id", "payload.label")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (o_orderstatus <> 'F' OR o_orderkey % 2 = 0) THEN 'new' ELSE 'old' END AS result, CASE WHEN o_orderkey % 3 = 0 AND (o_orderstatus <> 'F' OR o_orderkey % 2 = 0) THEN o_orderkey % 2 = 0 ELSE o_orderstatus = 'F' END AS ok FROM orders")
def snk10_upsert_guarded(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    old = o.select("o_orderkey", F.lit("old").alias("result"), (F.col("o_orderstatus") == "F").alias("ok"))
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("result"), (F.col("o_orderkey") % 2 == 0).alias("ok"))
    return writers.upsert_guarded(old, new, "o_orderkey", "result", "ok")


@query(oracle_sql_of("snk01_upsert"))
def snk01_upsert_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The same on a table in place, of which only touched partitions are read and replaced."""
    c, u = _customer_updates(spark, d)
    table = writers.PartitionedTable(spark, work_dir(spark), ["id"], 16)
    table.create(c.drop("created"))
    table.upsert(u.drop("created"))
    return table.read()


@query(oracle_sql_of("snk06_replace_keys"))
def snk06_replace_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The same on a table in place, of which only touched partitions are read and replaced."""
    from ..operators.windows import number_parts

    line = t(spark, d, "lineitem")
    new = number_parts(line.where("l_orderkey % 10 = 0 and l_quantity > 20"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "no", 1)
    table = writers.PartitionedTable(spark, work_dir(spark), ["l_orderkey"], 16)
    table.create(line.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("no")))
    table.replace_keys(new.select("l_orderkey", "l_partkey", F.col("no").cast(line.schema["l_linenumber"].dataType).alias("no")))
    return table.read()
