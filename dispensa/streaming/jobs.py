"""Streaming jobs over event streams, each with the batch form that gives the same final result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.writers import upsert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one; only a session on one machine may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/stream-{uuid.uuid4().hex}"


@contextmanager
def typed_state(spark: SparkSession):
    """Queries that are started inside keep typed state variables and timers, which needs the RocksDB store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(stream: DataFrame, each, folder: str, mode: str = "append") -> list:
    """Process all that is there, in micro-batches, then stop; the progress reports of the micro-batches."""
    with typed_state(stream.sparkSession):
        q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def period_of(ts: Column, first: int, last: int, periods: int) -> Column:
    """The number of the equal period, from 0, that a time falls in; first and last: microseconds."""
    return F.floor((F.unix_micros(ts) - first) * periods / F.lit(last - first + 1)).cast("int")


def replay(df: DataFrame, ts: str, periods: int, folder: str, run: Callable[[DataFrame], list]) -> list:
    """Let df land period by period of its time, and run a job after each landing, as a schedule would; all progress reports.

    A landing is one micro-batch of the job, which goes on from its checkpoint. Rows without a time land with the first.
    """
    spark = df.sparkSession
    time = F.col(ts).cast("timestamp")
    span = df.agg(F.unix_micros(F.min(time)).alias("a"), F.unix_micros(F.max(time)).alias("b")).first()
    reports = []
    for k in range(periods):
        own = df.where(F.coalesce(period_of(time, span["a"] or 0, span["b"] or 0, periods), F.lit(0)) == k)
        own.withColumn("period", F.lit(k)).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(own.withColumn("period", F.lit(k)).schema).parquet(f"{folder}/in/*")
        reports += run(stream)
    return reports


class VersionedTable:
    """A Parquet table that each micro-batch rewrites under its own number, from the newest complete version below it.

    So a batch that is run again replaces itself, and a query that starts again on its folder goes
    on where it was. The two newest versions are kept.
    """

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The complete versions, ascending."""
        fs, path = self._path("")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and fs.exists(self._path(f"{n}/_SUCCESS")[1]))

    def read(self, below: int | None = None) -> DataFrame:
        """The newest version, or the newest below a number; without one, no rows."""
        found = [v for v in self.versions() if below is None or v < below]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        for old in [v for v in self.versions() if v < version][:-1]:
            fs, path = self._path(f"v{old}")
            fs.delete(path, True)


def latest_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A key's latest values, with the time it was first seen."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in rest], F.min(order[0]).alias("created_at"), F.max(order[0]).alias("updated_at"))


def stream_upsert(stream: DataFrame, key: str, order: list[str], folder: str) -> DataFrame:
    """Fold a stream into a keyed table: latest values win, ``created_at`` stays."""
    spark = stream.sparkSession
    empty = latest_rows(spark.createDataFrame([], stream.schema), key, order)
    table = VersionedTable(spark, f"{folder}/table", empty.schema)

    def each(batch: DataFrame, number: int) -> None:
        table.write(upsert(table.read(number), latest_rows(batch, key, order), [key], ("created_at",)), number)

    run_available(stream, each, folder)
    return table.read()


def stream_dedup(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row of each key within the watermark's delay. A key's state goes ``delay`` after its row, counted in the watermark's time; a repeat
    after that comes back. Rows behind the watermark are dropped and counted in the progress report."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_append(stream: DataFrame, folder: str) -> DataFrame:
    append_once(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table").select(*stream.schema.names)


def append_once(stream: DataFrame, folder: str) -> list:
    """Add what is there to folder's table; a micro-batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    return run_available(stream, each, folder)


def toggle_state(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Final state of an on/off toggle per key: on after an odd number of events, and the time of the last."""
    return df.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("on"), F.max(ts).alias("changed_at"))


class Toggle(StatefulProcessor):
    """Keeps for each key whether it is on, and since when; gives both whenever a micro-batch touches the key."""

    def __init__(self, keys: list[str], ts: str):
        self.keys, self.ts = keys, ts

    def init(self, handle) -> None:
        self.state = handle.getValueState("toggle", "on boolean, changed_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        on, at = (bool(old[0]), old[1]) if old is not None else (False, None)
        for batch in rows:
            on ^= len(batch) % 2 == 1
            times = [t for t in [at, batch[self.ts].max()] if t is not None and t is not pd.NaT]
            at = pd.Timestamp(max(map(pd.Timestamp, times))).to_pydatetime() if times else None
        self.state.update((on, at))
        yield pd.DataFrame([(*key, on, at)], columns=[*self.keys, "on", "changed_at"])

    def close(self) -> None:
        pass


def _fields(stream: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in names)


def toggle_stream(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The same fold with typed state kept by Spark: emits the state of each key that a micro-batch touched."""
    own = stream.select(*keys, F.col(ts).cast("timestamp").alias(ts))
    return own.groupBy(*keys).transformWithStateInPandas(Toggle(keys, ts), f"{_fields(own, *keys)}, on boolean, changed_at timestamp", "Update", "None")


def toggle_table(stream: DataFrame, keys: list[str], ts: str, folder: str) -> DataFrame:
    """The state of every key after all that the stream holds."""
    spark = stream.sparkSession
    states = toggle_stream(stream, keys, ts)
    table = VersionedTable(spark, f"{folder}/table", states.schema)

    def each(batch: DataFrame, number: int) -> None:
        table.write(upsert(table.read(number), batch, keys), number)

    run_available(states, each, folder, "update")
    return table.read()


def _generations(times: np.ndarray, last: int | None, ttl: int) -> np.ndarray:
    """Places of ascending times at which a result is made anew after one made at ``last``: jumps from one to the next."""
    if not len(times):
        return np.zeros(0, np.int64)
    after = np.searchsorted(times, times + ttl).tolist()
    at = 0 if last is None else int(np.searchsorted(times, last + ttl))
    found = []
    while at < len(times):
        found.append(at)
        at = after[at]
    return np.array(found, np.int64)


def ttl_rows(df: DataFrame, key: str, seconds: Column, ttl: int = 600) -> DataFrame:
    """(key, made): a row for each time at which a cached result is made anew, being ``ttl`` seconds old or more. A task streams a key's times and holds the last one only."""
    rows = df.select(key, seconds.cast("long").alias("made")).where("made is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = None, None  # the last key of the batches so far, and when its result was made
        for batch in (b for b in batches if b.num_rows):
            coded = batch.column(0).dictionary_encode()
            number, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary
            times = batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            keep = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
                name = (names[int(number[a])].as_py() if number[a] >= 0 else None,)
                own = a + _generations(times[a:b], last if name == known else None, ttl)
                last = int(times[own[-1]]) if len(own) else last
                known = name
                keep.append(own)
            yield batch.take(pa.array(np.concatenate(keep)))

    return rows.repartition(key).sortWithinPartitions(key, "made").mapInArrow(run, rows.schema)


def ttl_generations(df: DataFrame, key: str, seconds: Column, ttl: int = 600) -> DataFrame:
    """(key, generations): the times of ttl_rows as one array."""
    made = ttl_rows(df, key, seconds, ttl).groupBy(key).agg(F.array_sort(F.collect_list("made")).alias("generations"))
    return df.select(key).distinct().withColumnRenamed(key, "__k").join(made, F.col("__k").eqNullSafe(F.col(key)), "left").select(F.col("__k").alias(key), F.coalesce("generations", F.array().cast("array<bigint>")).alias("generations"))


SHIFT = 1 << 32  # seconds (136 years) that event times are put off, as the first watermark of a stream is 1970 and would drop what is before it; pandas ends in 2262


class Generations(StatefulProcessor):
    """Keeps when a key's result was made, until it is ``ttl`` seconds old.

    By event time a timer clears the state once the watermark is past that age: whatever comes later makes the result anew,
    with the state or without it. By processing time (``live``) the store itself lets go of it.
    """

    def __init__(self, key: str, seconds: str, ttl: int, live: bool):
        self.key, self.seconds, self.ttl, self.live = key, seconds, ttl, live

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("made", "made long", self.ttl * 1000 if self.live else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([np.zeros(0, np.int64), *(x[self.seconds].dropna().to_numpy(np.int64) for x in rows if len(x))]))
        old = self.last.get()
        last = int(old[0]) if old is not None else None
        if self.live:  # the store holds it only while it is young enough; a request now finds it or makes it
            made = times[:1] if last is None else times[:0]
        else:
            made = times[_generations(times, last, self.ttl)]
        if len(made):
            self.last.update((int(made[-1]),))
            if not self.live:
                if last is not None:
                    self.handle.deleteTimer((last + self.ttl + SHIFT) * 1000)
                self.handle.registerTimer((int(made[-1]) + self.ttl + SHIFT) * 1000)
        yield pd.DataFrame({self.key: [key[0]] * len(made), "made": made})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({self.key: [], "made": []})

    def close(self) -> None:
        pass


def ttl_stream(stream: DataFrame, key: str, ts: str, ttl: int = 600, delay: str = "1 second", live: bool = False) -> DataFrame:
    """ttl_rows with a key's last time kept by Spark and given up when it is ``ttl`` seconds old, for events in order of time from one micro-batch to the next.

    Events more than ``delay`` behind the newest of earlier micro-batches are dropped. With ``live`` a result's age is that of the
    clock on the wall, as a cache's in front of users, and each micro-batch is one request at most.
    """
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    own = stream.select(key, F.timestamp_seconds(seconds + SHIFT).alias("seen_at"), seconds.alias("seen_s"))
    own = own if live else own.withWatermark("seen_at", delay)
    return own.groupBy(key).transformWithStateInPandas(Generations(key, "seen_s", ttl, live), f"{_fields(own, key)}, made long", "Append", "ProcessingTime" if live else "EventTime")


def running_count(df: DataFrame, key: str, order: list) -> DataFrame:
    """Results so far and in all, per key."""
    w = Window.partitionBy(key)
    return df.withColumns({"so_far": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)})


def running_count_stream(stream: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, so_far): each result with its number among its key's results, in order of arrival; the newest number is the total.

    Spark keeps one number for each key; a task sees a key's rows in batches, never all at once.
    """

    def fold(k, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for batch in rows:
            yield pd.DataFrame({key: [k[0]] * len(batch), item: batch[item].to_numpy(), "so_far": range(n + 1, n + len(batch) + 1)})
            n += len(batch)
        state.update((n,))

    fields = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (key, item))
    return stream.select(key, item).groupBy(key).applyInPandasWithState(fold, f"{fields}, so_far long", "n long", "append", "NoTimeout")


def batch_totals(spark: SparkSession, reports: list, name: str) -> DataFrame:
    """(batch, each observed metric, so_far, total) from the progress reports of a job that observes ``name`` with a metric n."""
    seen = {r.batchId: r.observedMetrics[name].asDict() for r in reports if name in r.observedMetrics}
    counted = [(int(b), m) for b, m in sorted(seen.items()) if m["n"]]
    total, so_far, rows = sum(m["n"] for _, m in counted), 0, []
    for place, (_, m) in enumerate(counted):
        so_far += m["n"]
        rows.append((place, *m.values(), so_far, total))
    metrics = list(counted[0][1]) if counted else ["n"]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("batch", *metrics, "so_far", "total")))
