"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that ``written`` made and ``forget`` has not removed yet, by application.
_made: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; ``forget`` removes it. Below a temporary folder only where that is unset and the master is local (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def forget(spark: SparkSession) -> None:
    """Removes the tables that this application has written here. Results that were not written elsewhere are lost with them, so call it after the job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, so that what several branches of a plan use is computed once and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def different(rows: DataFrame, column: str) -> DataFrame:
    """The different values of a column, written: Spark would drop this distinct below a later one, and compute what follows for every row."""
    return written(rows.select(column).filter(F.col(column).isNotNull()).distinct(), f"different-{column.replace('_', '-')}")


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``most_rows`` rows; the result is the same either way."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
