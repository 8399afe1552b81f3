"""The corpus pipeline: each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlink.functions.workers import ship
from recordlink.llm import bpe, common, jaccard, mixing, quality, secrets

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", jaccard.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("tokens", bpe.stage),
]

#: The last stages hash and encode in ways that SQL does not have; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
