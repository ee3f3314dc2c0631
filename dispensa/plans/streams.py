"""Queries over streams: files are read as a stream, all of it is processed, and the final table is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query
from .views import t


def _events(spark: SparkSession, d: str) -> DataFrame:
    # A stream watches a folder; the table may be one file in it or a folder of its own.
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, min(ts)::DATE::VARCHAR AS created_at, max(ts)::DATE::VARCHAR AS updated_at FROM events GROUP BY user_id")
def stm01_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.stream_upsert(_events(spark, d).select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], jobs.work_dir(spark))
    return out.select("user_id", "event_type", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"))


# Six landings of equal time, five days of a month each.
_PERIODS = 6
_LANDED = f"span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events), landed AS (SELECT e.*, floor((epoch_us(ts) - a) * {_PERIODS} / (b - a + 1)::DOUBLE)::INT AS period FROM events e, span)"


@query(f"""WITH RECURSIVE {_LANDED}, k AS (SELECT DISTINCT user_id, event_type, period FROM landed),
out AS (SELECT user_id, event_type, min(period) AS period FROM k GROUP BY ALL UNION ALL SELECT user_id, event_type, period FROM (SELECT k.user_id, k.event_type, min(k.period) OVER (PARTITION BY k.user_id, k.event_type) AS least, k.period FROM k JOIN out ON k.user_id = out.user_id AND k.event_type = out.event_type AND k.period >= out.period + 3) WHERE period = least)
SELECT user_id, event_type, period FROM out""")
def stm02_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events land every five days, and that is their time. With a delay of four days a key is forgotten once the watermark, four days behind the newest landing, is four
    days past the key's: at the end of the second landing after its own. So it comes back from the third on."""
    folder = jobs.work_dir(spark)
    landed = lambda s: s.withColumn("landed_at", F.timestamp_seconds(F.lit(5 * 86400) * (F.col("period") + 1)))
    once = lambda s: jobs.append_once(jobs.stream_dedup(landed(s), ["user_id", "event_type"], "landed_at", "4 days"), folder)
    jobs.replay(t(spark, d, "events").select("user_id", "event_type", "ts"), "ts", _PERIODS, folder, once)
    return spark.read.schema("user_id long, event_type string, period int").parquet(f"{folder}/table").select("user_id", "event_type", "period")


@query("SELECT user_id, event_type, count(*) % 2 = 1 AS is_on, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS changed_at FROM events GROUP BY user_id, event_type")
def stm03_toggle_state(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.toggle_table(_events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", jobs.work_dir(spark))
    return out.select("user_id", "event_type", F.col("on").alias("is_on"), F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed_at"))


_GENERATIONS = """WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT) AS i FROM events),
g AS (SELECT user_id, i, s, s AS made, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.s, CASE WHEN e.s - g.made >= 86400 THEN e.s ELSE g.made END, CASE WHEN e.s - g.made >= 86400 THEN g.n + 1 ELSE g.n END FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, max(n)::BIGINT AS n, max(made) AS last FROM g GROUP BY user_id"""


@query(_GENERATIONS)
def stm04_ttl_generations(spark: SparkSession, d: str) -> DataFrame:
    made = jobs.ttl_rows(t(spark, d, "events"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")), 86400)
    return made.groupBy("user_id").agg(F.count("*").alias("n"), F.max("made").alias("last"))


@query(_GENERATIONS)
def stm04_ttl_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over landings of ten days as a stream, whose state holds a user only while their result is younger than a day."""
    folder = jobs.work_dir(spark)
    made = lambda s: jobs.append_once(jobs.ttl_stream(s, "user_id", "ts", 86400), folder)
    jobs.replay(t(spark, d, "events").select("user_id", "ts"), "ts", 3, folder, made)
    return spark.read.schema("user_id long, made long").parquet(f"{folder}/table").groupBy("user_id").agg(F.count("*").alias("n"), F.max("made").alias("last"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS so_far, count(*) OVER (PARTITION BY user_id) AS total FROM events")
def stm05_running_count(spark: SparkSession, d: str) -> DataFrame:
    return jobs.running_count(t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "so_far", "total")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS events, count(*) AS last FROM events GROUP BY user_id")
def stm05_running_count_stream(spark: SparkSession, d: str) -> DataFrame:
    """Numbers go by arrival, which no SQL knows; each user's must be 1 to their count, each once."""
    numbered = jobs.stream_append(jobs.running_count_stream(_events(spark, d), "user_id", "event_id"), jobs.work_dir(spark))
    return numbered.groupBy("user_id").agg(F.countDistinct("so_far").alias("n"), F.countDistinct("event_id").alias("events"), F.max("so_far").alias("last"))


@query(f"""WITH {_LANDED}, p AS (SELECT period, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases FROM landed GROUP BY period)
SELECT row_number() OVER (ORDER BY period) - 1 AS batch, n, purchases, sum(n) OVER (ORDER BY period)::BIGINT AS so_far, sum(n) OVER ()::BIGINT AS total FROM p""")
def stm05_batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each micro-batch from the progress reports of a job over landings, so far and in all."""
    folder = jobs.work_dir(spark)
    counted = lambda s: jobs.append_once(s.observe("seen", F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases")), folder)
    reports = jobs.replay(t(spark, d, "events").select("event_id", "event_type", "ts"), "ts", _PERIODS, folder, counted)
    return jobs.batch_totals(spark, reports, "seen")
