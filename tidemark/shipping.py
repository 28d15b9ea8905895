"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each Spark application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        to = tempfile.mkdtemp(prefix="tidemark-")
        context.addPyFile(shutil.make_archive(f"{to}/{root.name}", "zip", root.parent, root.name))
        _shipped.add(context.applicationId)
