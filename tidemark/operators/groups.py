"""Grouping shapes and summaries that reports share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scans


def overall_and_by(df: DataFrame, key: str, aggregates: Sequence[Column], name: str = "grp") -> DataFrame:
    """One row for all rows (named ALL) and one for each key, in one pass."""
    out = df.groupingSets([[], [key]], key).agg(*aggregates, F.grouping_id().alias("__g"))
    return out.select(F.when(F.col("__g") == 0, F.col(key)).otherwise("ALL").alias(name), *[c for c in out.columns if c not in (key, "__g")])


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage; null for nothing."""
    return F.round(100 * part / F.nullif(whole, F.lit(0)), digits)


def with_percentiles(found: DataFrame, rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``found``, one row for each group, with exact percentiles of ``rows`` under the names of ``wanted`` (column, share)."""
    at = sorted({q for _, q in wanted.values()})
    columns = sorted({c for c, _ in wanted.values()})
    values = scans.percentiles(rows.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)), by, columns, at)
    pick = [F.max(F.when(F.col("column") == c, F.col("q")[at.index(q)])).alias(name) for name, (c, q) in wanted.items()]
    return found.join(values.groupBy(*by).agg(*pick), by, "left")


def each_and_all(rows: DataFrame, key: str, name: str = "grp") -> DataFrame:
    """Rows once for their key and once for ALL."""
    return rows.withColumn(name, F.explode(F.array(F.lit("ALL"), key)))
