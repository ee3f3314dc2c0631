"""Scans of landed reference tables, documents and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = "^[0-9]{8}$"


def pick_charset(spark: SparkSession, path: str, charsets: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> str:
    """The first charset that reads the file without replacement characters, else the last."""
    for name in charsets[:-1]:
        bad = spark.read.option("encoding", name).option("sep", "\x00").csv(path).select(F.col("_c0").contains("�").alias("bad"))
        if not bad.where("bad").limit(1).count():
            return name
    return charsets[-1]


def scan_tsv(spark: SparkSession, path: str, columns: list[str], charsets: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Headerless tab-separated file, every column a string, blank cells null, rows kept whose first column is 8 digits."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, sep="\t", header=False, schema=schema, encoding=pick_charset(spark, path, charsets), quote="")
    return keep_codes(rows, columns[0])


def split_tsv(lines: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """The same from lines of text that are already in a column."""
    parts = F.split(line, "\t")
    rows = lines.select(*[F.nullif(F.trim(F.get(parts, k)), F.lit("")).alias(c) for k, c in enumerate(columns)])
    return keep_codes(rows, columns[0])


def keep_codes(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(key, F.trim(key)).where(F.col(key).rlike(CODE))


def ymd_or_null(value: Column) -> Column:
    """A yyyymmdd date as an integer, null unless it has 8 digits."""
    return F.when(F.trim(value).rlike(CODE), F.trim(value).cast("int"))


def repair_ragged(lines: DataFrame, line: str = "line") -> DataFrame:
    """Eight-column composition lines with stray tabs: the last (SA or FT, rank) pair ends the reference text, whose parts are joined again."""
    parts = lines.select(F.transform(F.split(line, "\t"), lambda x: F.trim(x)).alias("p"))
    ends = F.filter(F.sequence(F.lit(5), F.greatest(F.size("p") - 2, F.lit(5))), lambda i: F.get(F.col("p"), i).isin("SA", "FT") & F.coalesce(F.get(F.col("p"), i + 1).rlike("^[0-9]+$"), F.lit(False)))
    found = parts.withColumn("i", F.array_max(ends)).where("i is not null")
    at = lambda k: F.get(F.col("p"), F.lit(k))
    rows = found.select(at(0).alias("code"), at(1).alias("form"), at(2).alias("substance_code"), at(3).alias("label"), at(4).alias("dosage"), F.array_join(F.slice("p", F.lit(6), F.col("i") - 5), " ").alias("reference"), F.get(F.col("p"), F.col("i")).alias("kind"), F.get(F.col("p"), F.col("i") + 1).cast("int").alias("rank"))
    return rows.where(F.col("code").rlike(CODE))


def scan_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct 8-digit codes, trimmed."""
    return df.select(F.trim(column).alias("code")).where(F.col("code").rlike(CODE)).distinct()


def url_worklist(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct addresses without their fragment; the first ``limit`` by address on request."""
    out = df.select(F.trim(F.substring_index(column, "#", 1)).alias("url")).where("url <> ''").distinct()
    return out if limit is None else out.orderBy("url").limit(limit)


def explode_packages(records: DataFrame, packages: str, code: str) -> DataFrame:
    """One row per package that has a code; records without packages give none."""
    return records.withColumn("package", F.explode(packages)).where(F.col(f"package.{code}").isNotNull()).drop(packages)


def import_envelopes(df: DataFrame, status: str, data: str, url: str, version: str) -> DataFrame:
    """Payloads of successful envelopes with their address and schema version (2 unless given)."""
    return df.where((F.col(status) == "success") & F.col(data).isNotNull()).select(F.col(url).alias("url"), F.coalesce(F.col(version), F.lit(2)).alias("schema_version"), F.col(data).alias("data"))


def is_object(v: Column) -> Column:
    """Whether a variant is a JSON object."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def import_envelope_files(spark: SparkSession, glob: str) -> DataFrame:
    """(url, own_url, schema_version, source, data) from files of JSON envelopes, an array or a single one for each file, whatever the types of their members.

    Only objects whose status is ``success``, whose data is an object, and whose metadata has an address count; that is the key. The data's own
    address is the same unless given; the version is 2 unless given, as text; a source that is no object is an empty one; data stays a
    variant. An address is a text that is not empty. Files that are not JSON give nothing. A file is held whole by one task.
    """
    files = spark.read.text(glob, wholetext=True).select(F.try_parse_json("value").alias("v"))
    get = lambda path, kind: F.expr(f"try_variant_get(e, '$.{path}', '{kind}')")
    each = files.select(F.explode(F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))).alias("e")).where(is_object(F.col("e")))
    own = each.where((get("status", "string") == "success") & is_object(get("data", "variant")))
    text = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", F.nullif(get(path, "string"), F.lit("")))
    source = get("data.source", "variant")
    return own.where(text("data.metadata.url").isNotNull()).select(
        text("data.metadata.url").alias("url"),
        F.coalesce(text("data.url"), text("data.metadata.url")).alias("own_url"),
        F.coalesce(get("data.schema_version", "string"), F.lit("2")).alias("schema_version"),
        F.when(is_object(source), F.to_json(source)).otherwise(F.lit("{}")).alias("source"),
        get("data", "variant").alias("data"),
    )


def import_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON arrays of records, one array for each file; an exported object id is dropped. Without a schema the records are read twice, to find one."""
    df = spark.read.json(path, multiLine=True, schema=schema)
    exported = "_id" in df.columns and "$oid" in getattr(df.schema["_id"].dataType, "names", [])
    return df.drop("_id") if exported else df


def scan_binary_corpus(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """PDF files below numeric folders (or ``name=number`` ones): the folder is the document's number; SHA-256 of each file.

    Spark lists up to 10,000 folders in a task for each, and reckons 4 MB for opening a file and so gives a task a few files; for many
    small ones ``tasks`` says how many tasks share them all.
    """
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, str(tasks or before))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    finally:
        spark.conf.set(listing, before)
    files = files.coalesce(tasks) if tasks else files
    number = F.regexp_extract("path", r"/(?:[^/=]+=)?([0-9]+)/[^/]+$", 1)
    return files.select(number.alias("document"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), "length").where("document <> ''")


_NAMES = ("targets", "enzymes", "transporters", "carriers", "pathways", "drug-interactions")
_ID = "array<struct<_VALUE:string,_primary:string>>"
DRUG_SCHEMA = (
    f"`drugbank-id` {_ID}, name string, synonyms struct<synonym:array<string>>, `atc-codes` struct<`atc-code`:array<struct<_code:string>>>, "
    "`calculated-properties` struct<property:array<struct<kind:string,value:string>>>, `external-identifiers` struct<`external-identifier`:array<struct<resource:string,identifier:string>>>, "
    "products struct<product:array<struct<name:string,labeller:string,country:string>>>, "
    + ", ".join(f"`{n}` struct<`{n.removesuffix('s')}`:array<struct<`drugbank-id`:string,id:string,name:string,description:string>>>" for n in _NAMES)
)


def scan_drug_xml(spark: SparkSession, path: str, most_synonyms: int | None = None, most_products: int | None = None) -> DataFrame:
    """One row per outermost drug element, with ids, names, codes, structure keys, products and child lists; names and products are cut on request only."""
    cut = lambda c, most: c if most is None else F.slice(c, 1, most)
    df = spark.read.format("xml").option("rowTag", "drug").schema(DRUG_SCHEMA).load(path)
    first = lambda arr, test, field: F.get(F.filter(arr, test), F.lit(0))[field]
    ids = F.coalesce(F.col("`drugbank-id`"), F.array().cast(_ID))
    names = F.filter(F.transform(F.coalesce("synonyms.synonym", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    upper = F.transform(names, F.upper)
    distinct = F.filter(F.transform(names, lambda x, i: F.when(F.array_position(upper, F.upper(x)) == i + 1, x)), lambda x: x.isNotNull())
    prop = lambda kind: first(F.col("calculated-properties.property"), lambda p: p["kind"] == kind, "value")
    ext = lambda name: first(F.col("external-identifiers.external-identifier"), lambda p: p["resource"].contains(name), "identifier")
    blocks = [F.coalesce(F.col(f"`{n}`.`{n.removesuffix('s')}`"), F.array()).alias(n.replace("-", "_")) for n in _NAMES]
    products = F.filter("products.product", lambda p: F.coalesce(p["name"], p["labeller"], p["country"]).isNotNull())
    return df.select(
        F.coalesce(first(ids, lambda x: x["_primary"] == "true", "_VALUE"), F.get(ids, F.lit(0))["_VALUE"]).alias("drug_id"),
        F.transform(ids, lambda x: x["_VALUE"]).alias("all_ids"),
        F.trim("name").alias("name"),
        cut(distinct, most_synonyms).alias("synonyms"),
        F.array_distinct(F.transform("atc-codes.atc-code", lambda x: x["_code"])).alias("atc_codes"),
        prop("InChIKey").alias("inchi_key"),
        prop("InChI").alias("inchi"),
        prop("SMILES").alias("smiles"),
        ext("CAS").alias("cas"),
        ext("UNII").alias("unii"),
        cut(products, most_products).alias("products"),
        *blocks,
    )


def union_generations(frames: list[DataFrame]) -> DataFrame:
    """Rows of several schema generations; what a generation lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
