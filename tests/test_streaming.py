import time

from pyspark.sql import functions as F

from dispensa.streaming import jobs

ROWS = [(1, "a", 0), (1, "a", 100), (1, "b", 650), (1, "a", 700), (2, "a", 1300)]


def stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "user_id long, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for k, part in enumerate((df.where("s < 650"), df.where("s >= 650"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))


def test_upsert_of_a_stream_equals_the_batch(spark, tmp_path):
    df, s = stream(spark, tmp_path)
    got = jobs.stream_upsert(s, "user_id", ["ts", "s"], jobs.work_dir(spark))
    want = jobs.latest_rows(df, "user_id", ["ts", "s"])
    assert sorted(map(tuple, got.select("user_id", "kind", "created_at", "updated_at").collect())) == sorted(map(tuple, want.select("user_id", "kind", "created_at", "updated_at").collect()))


def test_toggle_stream_equals_the_batch(spark, tmp_path):
    """State and time of every key, over micro-batches and a restart, with a row without a time."""
    df, _ = stream(spark, tmp_path)
    df = df.unionByName(spark.createDataFrame([(3, "a", 5)], df.select("user_id", "kind", "s").schema).withColumn("ts", F.lit(None).cast("timestamp")))
    folder = jobs.work_dir(spark)
    jobs.replay(df, "ts", 3, folder, lambda s: jobs.toggle_table(s, ["user_id", "kind"], "ts", folder) and [])
    got = jobs.VersionedTable(spark, f"{folder}/table", "user_id long, kind string, on boolean, changed_at timestamp").read()
    want = jobs.toggle_state(df, ["user_id", "kind"], "ts")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 4


def test_dedup_of_a_stream(spark, tmp_path):
    _, s = stream(spark, tmp_path)
    got = jobs.stream_append(jobs.stream_dedup(s, ["user_id", "kind"], "ts", "1000 days"), jobs.work_dir(spark))
    assert sorted((r.user_id, r.kind) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_cached_result_generations(spark):
    df = spark.createDataFrame([(1, s) for s in (0, 100, 650, 700, 1300)], "k int, s long")
    assert jobs.ttl_generations(df, "k", F.col("s"), 600).first().generations == [0, 650, 1300]


def test_upsert_goes_on_after_a_restart_and_replaces_a_batch_that_is_run_again(spark, tmp_path):
    schema, folder = "user_id long, kind string, s long", str(tmp_path / "job")
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in*"))
    for k in range(4):
        spark.createDataFrame([(k, "a", k), (9, f"k{k}", k)], schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        got = jobs.stream_upsert(read(), "user_id", ["s"], folder)
        assert {(r.user_id, r.kind, r.created_at) for r in got.collect()} == {(i, "a", i) for i in range(k + 1)} | {(9, f"k{k}", 0)}
    table = jobs.VersionedTable(spark, f"{folder}/table", got.schema)
    assert table.versions() == [2, 3]
    before = sorted(map(tuple, table.read().collect()))
    (tmp_path / "job" / "offsets" / "commits" / "3").unlink()  # the job died before it could note that batch 3 was done
    (tmp_path / "job" / "offsets" / "commits" / ".3.crc").unlink(missing_ok=True)
    again = jobs.stream_upsert(read(), "user_id", ["s"], folder)
    assert sorted(map(tuple, again.collect())) == before and table.versions() == [2, 3]


def test_dedup_forgets_keys_and_drops_late_rows(spark):
    """A repeat within the delay goes, one after it comes back, and a row behind the watermark is dropped and counted."""
    folder, day, reports = jobs.work_dir(spark), 86400, []
    for k, rows in enumerate([[("a", 10), ("b", 10)], [("a", 12)], [("c", 20)], [("a", 21), ("late", 3)]]):
        spark.createDataFrame([(x, d * day) for x, d in rows], "key string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(f"{folder}/in/{k}")
        s = spark.readStream.schema("key string, s long, ts timestamp").parquet(f"{folder}/in/*")
        reports += jobs.append_once(jobs.stream_dedup(s, ["key"], "ts", "4 days"), folder)
    got = spark.read.schema("key string, s long").parquet(f"{folder}/table").collect()
    assert sorted((r.key, r.s // day) for r in got) == [("a", 10), ("a", 21), ("b", 10), ("c", 20)]
    operators = [o for r in reports for o in r.stateOperators]
    assert sum(o.numRowsDroppedByWatermark for o in operators) == 1
    assert operators[-1].numRowsTotal == 2  # a and c; what was seen on day 10 is gone


def test_generations_of_a_stream_equal_the_batch_and_expired_keys_leave_the_state(spark):
    rows = [(1, s) for s in (10, 100, 650, 700, 1300, 9000)] + [(2, 50), (3, 8999), (3, None)]
    df = spark.createDataFrame(rows, "k int, s long").withColumn("ts", F.timestamp_seconds("s"))
    folder = jobs.work_dir(spark)
    jobs.replay(df, "ts", 4, folder, lambda s: jobs.append_once(jobs.ttl_stream(s, "k", "ts", 600), folder))
    got = spark.read.parquet(f"{folder}/table").select("k", "made")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.ttl_rows(df, "k", F.col("s"), 600).collect()))
    held = spark.read.format("statestore").option("stateVarName", "made").load(f"{folder}/offsets")
    assert sorted((r.key.k, r.value.made) for r in held.collect()) == [(1, 9000), (3, 8999)]  # key 2 was cleared by its timer


def test_live_results_expire_by_the_clock(spark):
    """Requests of one key: those that come while the result is young find it, one that comes later makes it anew."""
    folder, made, seen = jobs.work_dir(spark), [], []
    schema = "k int, s long, ts timestamp"

    def request(s):
        spark.createDataFrame([(1, s)], "k int, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{folder}/in/{s}")

    def each(batch, number):
        made.extend(r.made for r in batch.collect())
        seen.append(number)

    def until(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            time.sleep(0.2)

    request(1)
    states = jobs.ttl_stream(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), "k", "ts", 20, live=True)
    with jobs.typed_state(spark):
        q = states.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{folder}/offsets").trigger(processingTime="0 seconds").start()
    try:
        until(lambda: made)
        request(2)
        first = len(seen)
        until(lambda: len(seen) > first + 1)
        time.sleep(21)
        request(3)
        until(lambda: len(made) > 1)
    finally:
        q.stop()
    assert made == [1, 3]


def test_generations_jump_over_batches_of_a_key(spark):
    """Keys that go on from one Arrow batch to the next, null keys and null times."""
    rows = [(k, s) for k in (1, 2, None) for s in range(0, 5000, 7)] + [(4, None)]
    df = spark.createDataFrame(rows, "k int, s long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = sorted(map(str, jobs.ttl_rows(df, "k", F.col("s"), 600).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], None
    for s in range(0, 5000, 7):
        if last is None or s - last >= 600:
            want.append(s)
            last = s
    assert got == sorted(f"Row(k={k}, made={s})" for k in (1, 2, None) for s in want)


def test_totals_from_progress_reports(spark):
    df = spark.range(100).withColumn("ts", F.timestamp_seconds("id"))
    folder = jobs.work_dir(spark)
    reports = jobs.replay(df, "ts", 4, folder, lambda s: jobs.append_once(s.observe("seen", F.count("*").alias("n"), F.count_if(F.col("id") % 2 == 0).alias("even")), folder))
    assert [tuple(r) for r in jobs.batch_totals(spark, reports, "seen").collect()] == [(0, 25, 13, 25, 100), (1, 25, 12, 50, 100), (2, 25, 13, 75, 100), (3, 25, 12, 100, 100)]
    assert jobs.batch_totals(spark, [], "seen").columns == ["batch", "n", "so_far", "total"]
