"""A corpus pipeline over the table documents: quality rules, line dedup, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensa.llm import jaccard, line_dedup, packing, quality, suffix_dedup
from dispensa.llm.entry import _path
from dispensa.llm.state import materialise, without
from dispensa.session import ready

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive fences."""
    ready(spark)
    return quality.keep_good(docs).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller document has too."""
    ready(spark)
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that links connect."""
    ready(spark)
    found = jaccard.near_duplicates(docs)
    return without(docs, found.where("doc_id is null and component_id is not null or doc_id <> component_id")).select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a smaller document has too; a character that a string only touches stays."""
    ready(spark)
    done = suffix_dedup.dedup_bytes(docs, carry=("lang", "source"))
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    ready(spark)
    return packing.pack(docs, _path("byte_bpe_50k.json"), 2048, weights=packing.WEIGHTS)


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", drop_passages), ("packing", pack)]
ORACLE_SQL = None  # the fences come from sketches and packing from a heuristic; tests hold the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
