"""Incremental ingest as Structured Streaming; each gives the rows of its batch counterpart."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordlink.functions import shared
from recordlink.operators import collection


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern takes a file as well as a folder


def run_once(stream: DataFrame, out: str, each: Callable[[DataFrame, int], None]) -> None:
    """``each`` for every micro-batch of what there is; the checkpoint lies below ``out``, so a restart goes on where the last commit was."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()


def earlier(spark: SparkSession, out: str, batch_id: int, schema) -> DataFrame:
    """What the batches before ``batch_id`` wrote; a batch that is repeated does not see its own first attempt."""
    rows = spark.read.schema(schema).option("basePath", f"{out}/data").parquet(f"{out}/data/batch=*") if batch_id else None
    return spark.createDataFrame([], schema) if rows is None else rows.filter(F.col("batch") < batch_id).drop("batch")


def merge_new(known: str, out: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that inserts only rows whose ``known`` key no earlier batch had."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropDuplicates([known])
        if batch_id:
            batch = batch.join(earlier(batch.sparkSession, out, batch_id, batch.schema), known, "left_anti")
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")  # a repeated batch overwrites itself

    return merge


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whose changes each batch adds to the checkpoint; the session has its own setting again afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def first_seen(rows: DataFrame, known: str, out: str) -> DataFrame:
    """The first row of each ``known`` key of a stream, over what there is. Which keys have come is state, dealt out by their hash: a batch asks for its own keys only and reads no earlier output. A repeated batch starts from the state
    before it and overwrites what it wrote."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    with on_disk(rows.sparkSession):
        run_once(rows.dropDuplicates([known]), out, keep)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/data/*")


def new_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents (SHA-256) of the documents stream: a file that comes twice is taken once."""
    rows = _stream(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_hash"))
    return first_seen(rows, "file_hash", shared.folder(spark, "stream"))


def hourly_counts(stream: DataFrame, out: str) -> DataFrame:
    """Events (ts, event_type) per hour and kind, over what there is. Each micro-batch writes the sums of its own rows, which are added at the end: without state and watermark no row comes too late, in whatever order files arrive."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(hour, "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    run_once(stream, out, keep)
    got = stream.sparkSession.read.schema("hour timestamp, event_type string, n long").parquet(f"{out}/data/*")
    return got.groupBy("hour", "event_type").agg(F.sum("n").alias("n"))


def hourly_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_counts(_stream(spark, sf_dir, "events"), shared.folder(spark, "stream"))


def add_once(out: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for collection deltas: the sums of each batch under its number, so that a repeated batch replaces its own and adds nothing twice."""

    def add(batch: DataFrame, batch_id: int) -> None:
        collection.keyed(batch).groupBy(*collection.KEY).agg(F.sum("quantity").alias("quantity")).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return add


def streamed_collection(spark: SparkSession, sf_dir: str, delta: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The collection that the lineitem stream's deltas (``delta`` makes them of its rows) add up to."""
    out = shared.folder(spark, "stream")
    rows = collection.keyed(delta(_stream(spark, sf_dir, "lineitem")))
    run_once(rows, out, add_once(out))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in collection.KEY) + ", quantity long"
    return spark.read.schema(schema).parquet(f"{out}/data/*").groupBy(*collection.KEY).agg(F.sum("quantity").alias("quantity"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters per job: events so far and the last one's time, after all micro-batches."""
    rows = _stream(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    out = shared.folder(spark, "stream")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("b", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(f"user_id long, events long, last {rows.schema['last'].dataType.simpleString()}, b long").parquet(f"{out}/data/*")
    return got.groupBy("user_id").agg(F.max_by("events", "b").alias("events"), F.max_by("last", "b").alias("last"))


def heartbeats(events: DataFrame, job: str, ts: str, silence: int) -> DataFrame:
    """(job, beats): how many beats ``silence`` seconds apart fall into the gaps between a job's events."""
    gap = F.unix_micros(F.lead(ts).over(W.partitionBy(job).orderBy(ts))) - F.unix_micros(ts)
    return events.withColumn("_g", gap).groupBy(job).agg(F.sum(F.floor(F.coalesce("_g", F.lit(0)) / F.lit(silence * 1_000_000)).cast("long")).alias("beats"))


def beating(events: DataFrame, job: str, silence: str = "2 seconds") -> DataFrame:
    """A stream's events (a column ``job``, a string) as they come (kind ``event``, n their number so far), and of every job that is silent a ``beat`` after each ``silence`` (n: beats so far). Start it in append mode with a trigger by
    processing time: each job has a timer in the state store, which fires without new events too, and counts survive a restart from the checkpoint."""
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)

    def update(key, batches, state):
        seen, beats = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            beats += 1
            row = (key[0], "beat", beats)
        else:
            seen += sum(len(pdf) for pdf in batches)
            row = (key[0], "event", seen)
        state.update((seen, beats))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame([row], columns=["job", "kind", "n"])

    named = events.select(F.col(job).cast("string").alias("job"))
    return named.groupBy("job").applyInPandasWithState(update, "job string, kind string, n long", "seen long, beats long", "append", "ProcessingTimeTimeout")


def read_with(df: DataFrame, make: Callable[[], Callable], key: str, column: str, schema: str) -> DataFrame:
    """(key, fields of ``schema``, status, error): a user's reader over each row, in Arrow batches.

    ``make`` builds the reader once for each task (a model is loaded there); the reader takes a value and gives a dict. A row that fails becomes data, never an exception.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        reader = make()
        for pdf in batches:
            rows = []
            for k, v in zip(pdf[key].tolist(), pdf[column].tolist()):
                try:
                    got = reader(v)
                    rows.append((k, *[got.get(n) for n in names], "ok", None))
                except Exception as e:  # any failure of the user's reader
                    rows.append((k, *[None] * len(names), "error", str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, *names, "status", "error"])

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, {schema}, status string, error string")
