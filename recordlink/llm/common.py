"""Helpers that the training-data operators share: intermediate tables in the
cluster's shared folder, checked broadcasts, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local (tests), since executors elsewhere would not see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder


#: Folders that ``written`` made and ``forget`` has not removed yet.
_folders: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``forget`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session. Results that were not written elsewhere are lost with them, so call it after the job."""
    while _folders:
        remove(spark, _folders.pop())


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is (a shuffle join, split by AQE on skew).

    ``df`` should be a written table, since the rows are counted here.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Characters of texts and rows that a Python worker makes results for at once. Spark bounds the batches that it sends by bytes, but results can be larger than their texts.
SLICE_CHARS, SLICE_ROWS = 1_000_000, 512


def slices(texts, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of successive parts of a batch: at most ``SLICE_ROWS`` rows, and ``SLICE_CHARS`` characters unless one text alone is longer."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, (str, bytes)) else 0
        if i > lo and (i - lo >= SLICE_ROWS or held + n > chars):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts) or not len(texts):
        yield lo, len(texts)


def parts(batches: Iterator[pd.DataFrame], text: str = "text") -> Iterator[pd.DataFrame]:
    """The batches in slices of their column ``text``."""
    for pdf in batches:
        for lo, hi in slices(pdf[text]):
            yield pdf.iloc[lo:hi]
    tidy()


#: Functions with a ``functools`` cache that is large and kept in a worker from task to task.
kept: list = []


def tidy(but=None) -> None:
    """Hands memory back to the system, that of the caches in ``kept`` too (``but`` one): workers are kept for later stages, which need it."""
    for f in kept:
        if f is not but:
            f.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _forest(batches):
    """Union-find inside one task: edges in, one (root, node) row per other node out."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pd.DataFrame({"a": [root(x) for x in nodes], "b": nodes})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge list (a, b) of longs; component is the smallest node.

    Each task first contracts its own edges by union-find; then alternating large-star and small-star rounds
    (Kiveris et al. 2014) run as joins-free group aggregates until the edges stay the same. Every round
    is written to the shared folder. Nodes without an edge do not appear. Empty input gives an empty table.
    """
    cur = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    cur = written(cur.mapInPandas(_forest, "a long, b long").distinct(), "edges")
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        ordered = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:  # every neighbour of u larger than u links to the smallest of u's neighbourhood
            both = ordered.union(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:  # the neighbours smaller than u link to the smallest one
            both = ordered
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a <> b").distinct()

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = sign(cur)
    for _ in range(most_rounds if before[0] else 0):
        old = _folders[-1]
        cur = written(star(star(cur, True), False), "edges")
        now = sign(cur)
        _folders.remove(old)
        remove(spark, old)  # nothing reads the round before any more
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("connected components did not settle")
    pairs = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
