"""Streams against their batch results: files out of order, keys that come again, silence."""

import time

from pyspark.sql import functions as F

from recordlink.functions import shared
from recordlink.streaming import ingest


def files(spark, folder, n=40):
    """One file for each of ``n`` months, written newest first."""
    rows = spark.range(n * 50).select((F.col("id") % n).alias("month"), F.col("id"), F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"))
    rows = rows.withColumn("ts", F.expr("timestamp_micros(1700000000000000 - month * 2592000000000 + id * 60000000)")).withColumn("key", (F.col("id") % 700).cast("string")).cache()
    for m in range(n):
        rows.filter(F.col("month") == m).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return rows


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 7).parquet(f"{folder}/events.parquet")


def test_files_out_of_order_lose_nothing(spark, tmp_path):
    rows = files(spark, tmp_path)
    got = ingest.hourly_counts(stream(spark, tmp_path, rows.schema), shared.folder(spark, "stream")).collect()
    want = rows.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.n for r in got) == 2000


def test_a_key_is_new_once(spark, tmp_path):
    rows = files(spark, tmp_path, 20)
    before = spark.conf.get(ingest.STORE, None)
    out = shared.folder(spark, "stream")
    got = ingest.first_seen(stream(spark, tmp_path, rows.schema), "key", out).collect()
    assert len(got) == 700 and {r.key for r in got} == {str(i) for i in range(700)}
    assert spark.conf.get(ingest.STORE, None) == before
    rows.limit(5).withColumn("key", F.concat(F.lit("new"), "key")).union(rows.limit(5)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    again = ingest.first_seen(stream(spark, tmp_path, rows.schema), "key", out).collect()  # goes on from its checkpoint
    assert len(again) == 705


def test_a_silent_job_beats(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "user string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    beats = ingest.beating(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "user", "2 seconds")
    q = beats.writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.sql("select count(*) from beats where kind = 'beat' and n = 2").first()[0] < 2:
            time.sleep(0.5)
        got = {(r.job, r.kind, r.n) for r in spark.sql("select * from beats").collect()}
    finally:
        q.stop()
    assert {("a", "event", 2), ("b", "event", 1), ("a", "beat", 1), ("a", "beat", 2), ("b", "beat", 1), ("b", "beat", 2)} <= got
