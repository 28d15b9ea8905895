"""Checks that rows must pass before they are analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.views import SECOND

TOLERANCE_US = 1000
SESSION = r"^\d{8}T\d{6}Z-[0-9a-f]{8}$"


class CausalInvariantError(ValueError):
    """Ready rows that may hold what was not known yet."""


def causal_violation(ready: Column, spot_us: Column, snapshot_us: Column, end_us: Column, lag_us: Column) -> Column:
    """Why a ready row breaks the causal rule; null for a sound row and for rows that are not ready."""
    t = TOLERANCE_US
    missing = spot_us.isNull() | snapshot_us.isNull() | end_us.isNull() | lag_us.isNull()
    broken = (
        F.when(missing, "MISSING_TIMESTAMP")
        .when(snapshot_us > spot_us + t, "SNAPSHOT_AFTER_SPOT")
        .when(end_us > spot_us + t, "FEATURE_END_AFTER_SPOT")
        .when(lag_us < -t, "NEGATIVE_LAG")
        .when(F.abs(spot_us - snapshot_us - lag_us) > 2 * t, "LAG_INCONSISTENT")
    )
    return F.when(ready, broken)


def check_causal(rows: DataFrame, reason: Column, shown: list[str]) -> DataFrame:
    """The rows, or an error with the number of broken ones and five examples."""
    broken = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    n = broken.count()
    if n:
        raise CausalInvariantError(f"{n} ready rows break the causal rule, such as {[tuple(r) for r in broken.select(*shown, 'reason').orderBy(*shown).limit(5).collect()]}")
    return rows


def unsound_session(session: Column) -> Column:
    """True where the session id is not of the recorder's form."""
    return ~F.coalesce(session.rlike(SESSION), F.lit(False))


def unsound_label(source: Column, expected: str, labelled_us: Column, close_us: Column) -> Column:
    """True where a label lacks its source or was not made after the close."""
    return ~F.coalesce((source == expected) & (labelled_us > close_us), F.lit(False))
