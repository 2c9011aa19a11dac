from pyspark.sql import functions as F

from pathloom.operators import queues
from pathloom.plans import views
from pathloom.streaming import live


def drain(df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(checkpoint)).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_window_counts_equal_the_batch(spark, sf, tmp_path):
    rows = views.log(spark, sf).select("case_id", "activity", F.col("timestamp").cast("timestamp").alias("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(live.window_counts(stream, "1 day", late="60 days"), "windows", tmp_path / "a")
    want = rows.groupBy(F.window("timestamp", "1 day"), "activity").count()
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == rows.count()


def test_sessions_hold_every_event(spark, sf, tmp_path):
    rows = views.log(spark, sf).select("case_id", "activity", F.col("timestamp").cast("timestamp").alias("timestamp"))
    batch = live.case_sessions(rows)
    assert batch.agg(F.sum("n")).first()[0] == rows.count()
    assert batch.where("session_end <= session_start").count() == 0


def changed(spark, rows, folder, open_stays=False):
    rows.repartition(3).sortWithinPartitions("timestamp").write.parquet(str(folder / "in"))
    # An event far ahead moves the watermark past all others.
    ahead = rows.limit(1).withColumn("case_id", F.lit(-1)).withColumn("timestamp", F.expr("timestamp + INTERVAL 3000 DAYS"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = live.queue_changes(stream, "400 days", open_stays)
    query = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).start()
    query.processAllAvailable()
    ahead.write.mode("append").parquet(str(folder / "in"))
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).collect())


def test_live_queue_equals_change_points(spark, sf, tmp_path):
    dirty = views.log_dirty(spark, sf).where("case_id like '%|2024-01-0%'").dropna(subset=["activity"])
    rows = dirty.select(F.crc32(F.col("case_id").cast("binary")).alias("case_id"), "activity", F.col("timestamp").cast("timestamp").alias("timestamp"), "_seq")
    batch = queues.change_points(queues.state_intervals(dirty.withColumn("case_id", F.crc32(F.col("case_id").cast("binary")))))
    want = sorted((r.state, r.timestamp, r.delta) for r in batch.collect())
    assert len(want) > 100
    assert changed(spark, rows, tmp_path) == want


def test_open_stays_count_cases_that_wait(spark, tmp_path):
    rows = spark.sql("""select * from values (1, 'A', timestamp'2024-01-01 00:00:00', 0), (1, 'B', timestamp'2024-01-01 01:00:00', 1),
        (1, 'C', timestamp'2024-01-01 01:00:00', 2), (2, 'A', timestamp'2024-01-01 00:30:00', 0), (3, null, timestamp'2024-01-01 00:30:00', 0)
        as t(case_id, activity, timestamp, _seq)""")
    got = changed(spark, rows, tmp_path, True)
    assert [(state, delta) for state, _, delta in got] == [("A", 1), ("A", 1), ("A", -1), ("C", 1)]
