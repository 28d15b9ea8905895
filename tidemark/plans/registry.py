"""The queries over the market views, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import checks, evaluation, freezing, ingestion, modeling, outcomes, policies, quality, records, telemetry, trading

PARTS = (telemetry, quality, evaluation, trading, policies, modeling, ingestion, records, checks, outcomes, freezing)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.queries()["causal_features"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.oracle_sql().items()}
