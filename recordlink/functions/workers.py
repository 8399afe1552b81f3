"""Make this package importable on Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package with the application (``addPyFile``), once, unless ``PYTHONPATH`` has it already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "recordlink.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "recordlink").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
