"""Tables and documents that are replaced as a whole: label caches, reports, saved state."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.formats import write_csv


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts ``new`` in the place of ``path``; until the last rename the old one can be read."""
    at, fs = _path(spark, path)
    old = _path(spark, f"{path}.old-{uuid.uuid4().hex}")[0]
    had = fs.exists(at)
    if had:
        fs.rename(at, old)
    if not fs.rename(_path(spark, new)[0], at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot put {new} in the place of {path}")
    if had:
        fs.delete(old, True)


def rewrite(df: DataFrame, path: str, order: list[str]) -> None:
    """Replaces a Parquet table, sorted by ``order`` across its files.  ``df`` may read the old table."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(new)
    _swap(df.sparkSession, new, path)


def rotate(spark: SparkSession, path: str, columns: list[str]) -> str | None:
    """Moves a table with other columns aside, so that new rows never join a file of another layout; says where to."""
    at, fs = _path(spark, path)
    if not fs.exists(at) or spark.read.parquet(path).columns == columns:
        return None
    aside = f"{path}.rotated-{uuid.uuid4().hex}"
    fs.rename(at, _path(spark, aside)[0])
    return aside


def append_rows(df: DataFrame, path: str) -> str | None:
    """Appends rows to a table of the same columns; one of other columns is rotated first, and its new place returned."""
    aside = rotate(df.sparkSession, path, df.columns)
    df.write.mode("append").parquet(path)
    return aside


def write_report(df: DataFrame, path: str, rename: dict[str, str] | None = None) -> None:
    """A report as CSV, columns renamed, lists joined by ;."""
    write_csv(df.withColumnsRenamed(rename or {}), path)


def save_document(spark: SparkSession, path: str, document: Any) -> None:
    """A small JSON document with sorted keys, replaced as a whole."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    at, fs = _path(spark, new)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(document, sort_keys=True, indent=1).encode()))
    finally:
        out.close()
    _swap(spark, new, path)


def load_document(spark: SparkSession, path: str, default: Any = None) -> Any:
    """The document, or ``default`` where there is none or it is not JSON."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return default
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        return json.loads(text)
    except ValueError:
        return default
