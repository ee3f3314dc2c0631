"""The domain tables, as views over the given star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def substances(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("substance_id"), F.col("s_name").alias("label"))


def medicines(spark: SparkSession, d: str) -> DataFrame:
    """Active-ingredient sets: a part and the sorted suppliers of its lines.

    The sets are dealt by part already, so parts are dealt to them: a broadcast of all parts, whose estimate is far below their size, would be the driver's.
    """
    refs = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("refs"))
    part = t(spark, d, "part")
    return part.join(refs.hint("merge"), part["p_partkey"] == refs["l_partkey"]).select(F.col("p_partkey").alias("medicine_id"), F.concat(F.lit("medicine:"), F.col("p_partkey")).alias("medicine_key"), F.array("p_name").alias("inns"), F.col("p_name"), "refs")


def market(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Branded products: lines with their part, supplier and the supplier's nation; all columns, or those wanted.

    Every line has a part, a supplier and a nation, so a table from which no column is wanted is not joined:
    a line's part or supplier costs a shuffle of all lines once those tables are too large to broadcast.
    """
    line, part, supplier, nation = (t(spark, d, n) for n in ("lineitem", "part", "supplier", "nation"))
    every = {
        "market_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "medicine_ref": F.col("l_partkey"),
        "brand_title": F.col("p_name"),
        "country": F.col("n_name"),
        "laboratory": F.col("s_name"),
        "form": F.col("p_type"),
        "strength": F.col("p_size").cast("string"),
        "has_doc": F.col("l_returnflag") == "A",
        "updated_at": F.date_format("l_shipdate", "yyyy-MM-dd"),
    }
    wanted = columns or tuple(every)
    if {"brand_title", "form", "strength"} & set(wanted):
        line = line.join(part, line["l_partkey"] == part["p_partkey"])
    if {"country", "laboratory"} & set(wanted):
        line = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    if "country" in wanted:
        line = line.join(nation, line["s_nationkey"] == nation["n_nationkey"])
    return line.select(*[every[c].alias(c) for c in wanted])


MEDICINES = "medicines AS (SELECT p_partkey AS medicine_id, 'medicine:' || p_partkey AS medicine_key, p_name, list_sort(list(DISTINCT l_suppkey)) AS refs FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name)"
MARKET = "market AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS market_id, l_partkey AS medicine_ref, p_name AS brand_title, n_name AS country, s_name AS laboratory, p_type AS form, p_size::VARCHAR AS strength, l_returnflag = 'A' AS has_doc, strftime(l_shipdate, '%Y-%m-%d') AS updated_at FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
