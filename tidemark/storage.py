"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder does for a single machine (tests); a cluster would lose data there.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def reserved(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there lives as long as the tables of ``written``."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    if not made:
        atexit.register(_clear, spark)
    made.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder.

    Cuts the lineage: what follows reads the table, so a lost executor never recomputes what came before it.  The
    table lives until ``discard`` names it or the application ends.
    """
    spark = df.sparkSession
    path = reserved(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """A point in time for ``discard``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written after ``since``, but for the last ``keep``; their readers must be done."""
    made = _made.get(spark.sparkContext.applicationId, [])
    gone = made[since : len(made) - keep]
    made[since : len(made) - keep] = []
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear(spark: SparkSession) -> None:
    if SparkContext._active_spark_context is spark.sparkContext and spark.sparkContext._jsc is not None:
        discard(spark)
