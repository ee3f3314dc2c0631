"""Where jobs keep what must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only where that is unset on one machine, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: later jobs neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dispensa-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run meanwhile hand their Python tasks batches of about ``size`` bytes, not of thousands of whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete what ``materialise`` wrote for a table that nothing reads any more."""
    delete(table.sparkSession, table.stored_at)


BROADCAST_IDS = 1_000_000  # ids of at most 8 MB


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in gone(doc_id); a null id matches a null id.

    Ids are broadcast only if they are counted to be few, else both sides are shuffled.
    """
    last = F.lit((1 << 63) - 1)
    ids = materialise(gone.select(F.coalesce("doc_id", last).alias("__gone")).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.coalesce(docs[doc_id].cast("long"), last) == ids["__gone"], "left_anti")
