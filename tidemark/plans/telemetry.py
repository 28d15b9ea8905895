"""Queries over causal features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import features as feat
from tidemark.plans import sql_features as S
from tidemark.sources import views as V


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    ticks = V.ticks(spark, sf_dir)
    return V.spots(ticks), V.snapshots(ticks, C.TIME_SCALE), C.TIME_SCALE


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.causal_features(*inputs(spark, sf_dir))


#: Columns of the flagship.  They are rounded to four digits; here they are cut to two, off the grid of four, so that
#: neither the order of a sum nor a tie can show.
_SHOWN = ["spread", "premium", "mark_premium", "last_premium", "mid_mark_basis", *feat.PERP_VALUES, *(f"spot_ret_{h}" for h in C.HORIZONS), *(f"spot_rv_{w}" for w in C.RV_WINDOWS),
          "premium_stress", *(f"gap_{h}" for h in C.HORIZONS), "perp_shock_300", "perp_shock_900", "spot_shock_300", "spot_shock_900",
          *(f"{a}_z_{h}" for a in ("perp", "spot", "gap") for h in C.HORIZONS)]
_COUNTS = {"premium_z_5m_n", "premium_z_15m_n", "spread_n"}
_BASE = ["event_id", "coin", "us"]


def steady(x: str) -> F.Column:
    return (F.floor(F.col(x) * 100 + 0.1234) / 100).cast("double")


def steady_sql(x: str) -> str:
    return f"floor({x} * 100 + 0.1234::DOUBLE) / 100"


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*_BASE, *(F.col(c) if c in _COUNTS or c not in _SHOWN else steady(c).alias(c) for c in columns))


def _shown_sql(*columns: str) -> str:
    picked = ", ".join(c if c in _COUNTS or c not in _SHOWN else f"{steady_sql(c)} AS {c}" for c in columns)
    return S.features(f"SELECT event_id, coin, us, {picked} FROM features")


VIEWS = {
    "asof_pair": ("snapshot_id", "snapshot_us", "lag_us", "pair_ok", "perp_ok"),
    "causal_premium": ("pair_ok", "premium", "mark_premium", "last_premium", "mid_mark_basis"),
    "basis_and_spread": ("spread", "mid_mark_basis", "funding_rate"),
    "horizon_returns": (*(f"perp_ret_{h}" for h in C.HORIZONS), *(f"spot_ret_{h}" for h in C.HORIZONS)),
    "momentum_gap": tuple(f"gap_{h}" for h in C.HORIZONS),
    "premium_change": tuple(f"premium_change_{h}" for h in C.HORIZONS),
    "premium_zscore": ("premium_z_5m", "premium_z_5m_n", "premium_z_15m", "premium_z_15m_n", "premium_stress"),
    "realized_vol": (*(f"perp_rv_{w}" for w in C.RV_WINDOWS), *(f"spot_rv_{w}" for w in C.RV_WINDOWS)),
    "vol_shock": ("perp_shock_300", "perp_shock_900", "spot_shock_300", "spot_shock_900"),
    "spread_baseline": ("spread", "spread_median", "spread_n", "spread_ratio"),
    "momentum_z": tuple(f"{a}_z_{h}" for a in ("perp", "spot", "gap") for h in C.HORIZONS),
    "vol_regime": ("vol_regime", "ready"),
    "stability_state": ("ready", "stability", "reasons"),
    "quality_flags": ("flags",),
    "causal_features": ("session", "pair_ok", "perp_ok", "ready", *_SHOWN, "vol_regime", "stability", "reasons", "flags"),
}


def asof_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spot row with the newest snapshot at or before it; nothing but ids, times and states is read or shuffled."""
    spots, snapshots, scale = inputs(spark, sf_dir)
    rows = feat.paired(spots.select(*_BASE), snapshots.select(*_BASE, "source_status", "index_age_s"), scale)
    return rows.select(*_BASE, F.col("match.event_id").alias("snapshot_id"), F.col("match.us").alias("snapshot_us"), "lag_us", "pair_ok", "perp_ok")


def queries() -> dict:
    def view(columns: tuple[str, ...]):
        return lambda spark, sf_dir: _shown(features(spark, sf_dir), *columns)

    return {name: view(columns) for name, columns in VIEWS.items()} | {"asof_pair": asof_pair}


def oracle_sql() -> dict[str, str]:
    return {name: _shown_sql(*columns) for name, columns in VIEWS.items()}
