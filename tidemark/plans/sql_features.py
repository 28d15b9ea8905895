"""DuckDB text of the causal features."""

from tidemark.config import TIME_SCALE
from tidemark.sources.views import SQL

S = TIME_SCALE * 1_000_000


def _before(value: str, h: int) -> str:
    return f"last_value({value} IGNORE NULLS) OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {(h + 10) * S} PRECEDING AND {h * S} PRECEDING)"


def _rv(window: int, least: int, span: int) -> str:
    w = f"OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {window * S} PRECEDING AND CURRENT ROW)"
    return f"""round(CASE WHEN count(r2) {w} >= {least} AND us - first_value(us) {w} >= {span * S} AND sum(wide) {w} - first_value(wide) {w} = 0
        THEN sqrt(greatest(sum(r2) {w} - first_value(r2) {w}, 0) * 60.0::DOUBLE * {S} / (us - first_value(us) {w})) * 10000 END, 4)"""


def _z(window: int, least: int, span: int) -> str:
    w = f"OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {window * S - 1} PRECEDING AND CURRENT ROW)"
    return f"""round(CASE WHEN premium IS NOT NULL AND count(premium) {w} >= {least} AND us - min(CASE WHEN premium IS NOT NULL THEN us END) {w} >= {span * S}
        AND stddev_samp(premium) {w} > 1e-12 THEN (premium - avg(premium) {w}) / stddev_samp(premium) {w} END, 4)"""


def _flat(window: int, least: int, span: int) -> str:
    w = f"OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {window * S - 1} PRECEDING AND CURRENT ROW)"
    return f"(coalesce(premium IS NOT NULL AND count(premium) {w} >= {least} AND us - min(CASE WHEN premium IS NOT NULL THEN us END) {w} >= {span * S} AND stddev_samp(premium) {w} <= 1e-12, false))::BIGINT"


_SPREAD = f"OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {300 * S} PRECEDING AND 1 PRECEDING)"
_RV = {60: (6, 45), 300: (25, 225), 900: (75, 675)}
_H = (30, 60, 180)

PERP = f"""fresh_perps AS (
        SELECT *, coalesce(ln(mid / lag(mid) OVER w) ** 2, 0) AS r2, coalesce(us - lag(us) OVER w > {20 * S}, false)::INT AS wide
        FROM snapshots WHERE fresh AND mid IS NOT NULL WINDOW w AS (PARTITION BY coin ORDER BY us)),
    perp_values AS (
        SELECT event_id,
               {", ".join(f"round((mid / {_before('mid', h)} - 1) * 10000, 4) AS perp_ret_{h}, round(premium - {_before('premium', h)}, 4) AS premium_change_{h}" for h in _H)},
               {_z(300, 20, 240)} AS premium_z_5m, {_flat(300, 20, 240)} AS premium_z_5m_flat, {_flat(900, 60, 720)} AS premium_z_15m_flat, CASE WHEN premium IS NOT NULL THEN count(premium) OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {300 * S - 1} PRECEDING AND CURRENT ROW) ELSE 0 END AS premium_z_5m_n,
               {_z(900, 60, 720)} AS premium_z_15m, CASE WHEN premium IS NOT NULL THEN count(premium) OVER (PARTITION BY coin ORDER BY us RANGE BETWEEN {900 * S - 1} PRECEDING AND CURRENT ROW) ELSE 0 END AS premium_z_15m_n,
               {", ".join(f"{_rv(w, *x)} AS perp_rv_{w}" for w, x in _RV.items())},
               round(CASE WHEN count(spread) {_SPREAD} >= 20 AND max(us) {_SPREAD} - min(us) {_SPREAD} >= {240 * S} THEN quantile_cont(spread, 0.5) {_SPREAD} END, 4) AS spread_median,
               count(spread) {_SPREAD} AS spread_n, spread AS own_spread
        FROM fresh_perps),
    perp_features AS (
        SELECT * EXCLUDE (own_spread), round(CASE WHEN round(own_spread, 4) >= 0 AND spread_median > 1e-12 THEN round(own_spread, 4) / spread_median END, 4) AS spread_ratio FROM perp_values)"""

SPOT = f"""spot_steps AS (
        SELECT *, coalesce(ln(spot / lag(spot) OVER w) ** 2, 0) AS r2, coalesce(us - lag(us) OVER w > {20 * S}, false)::INT AS wide
        FROM spots WINDOW w AS (PARTITION BY coin ORDER BY us)),
    spot_features AS (
        SELECT * EXCLUDE (r2, wide), {", ".join(f"round((spot / {_before('spot', h)} - 1) * 10000, 4) AS spot_ret_{h}" for h in _H)},
               {", ".join(f"{_rv(w, *x)} AS spot_rv_{w}" for w, x in _RV.items())}
        FROM spot_steps)"""

PAIR = f"""paired AS (
        SELECT s.*, p.event_id AS snapshot_id, p.us AS snapshot_us, s.us - p.us AS lag_us, coalesce(s.us - p.us <= {8 * S}, false) AS pair_ok,
               coalesce(s.us - p.us <= {8 * S}, false) AND p.source_status = 'fresh' AND p.index_age_s * {S} + s.us - p.us <= {15 * S} AS perp_ok,
               p.source_status, p.index_age_s, p.mid IS NOT NULL AS has_mid, p.index_price IS NOT NULL AS has_index, p.bid, p.ask, p.mid, p.index_price, p.mark, p.last_price,
               p.funding_rate AS any_funding, p.spread AS any_spread, p.premium AS any_premium
        FROM spot_features s ASOF LEFT JOIN snapshots p ON s.coin = p.coin AND s.us >= p.us)"""


def _horizons(pattern: str) -> str:
    return ", ".join(pattern.replace("{h}", str(h)) for h in _H)


_PERP_VALUES = [*(f"perp_ret_{h}" for h in _H), *(f"premium_change_{h}" for h in _H), "premium_z_5m", "premium_z_5m_n", "premium_z_5m_flat", "premium_z_15m", "premium_z_15m_n", "premium_z_15m_flat", "perp_rv_60", "perp_rv_300", "perp_rv_900", "spread_median", "spread_n", "spread_ratio"]


def _sigma(v: str, h: int) -> str:
    return f"(CASE WHEN {v} >= 0.01 THEN {v} * sqrt({h} / 60.0::DOUBLE) END)"


CAUSAL = f"""joined AS (
        SELECT a.* EXCLUDE (any_funding, any_spread, any_premium), CASE WHEN perp_ok THEN any_funding END AS funding_rate, round(CASE WHEN perp_ok THEN any_spread END, 4) AS spread,
               round(CASE WHEN perp_ok THEN any_premium END, 4) AS premium,
               round(CASE WHEN perp_ok THEN (mark / index_price - 1) * 10000 END, 4) AS mark_premium, round(CASE WHEN perp_ok THEN (last_price / index_price - 1) * 10000 END, 4) AS last_premium,
               round(CASE WHEN perp_ok THEN (mid / mark - 1) * 10000 END, 4) AS mid_mark_basis,
               {", ".join(f"CASE WHEN perp_ok THEN {v} END AS {v}" for v in _PERP_VALUES)}
        FROM paired a LEFT JOIN perp_features f ON f.event_id = snapshot_id),
    derived AS (
        SELECT *, abs(premium_z_5m) AS premium_stress, {_horizons("round(perp_ret_{h} - spot_ret_{h}, 4) AS gap_{h}")},
               {", ".join(f"round(CASE WHEN {s}_rv_{w} > 0 THEN {s}_rv_60 / {s}_rv_{w} END, 4) AS {s}_shock_{w}" for s in ("perp", "spot") for w in (300, 900))}
        FROM joined),
    scaled AS (
        SELECT *, {", ".join(f"round(perp_ret_{h} / {_sigma('perp_rv_300', h)}, 4) AS perp_z_{h}, round(spot_ret_{h} / {_sigma('spot_rv_300', h)}, 4) AS spot_z_{h}, round(gap_{h} / sqrt({_sigma('perp_rv_300', h)} ** 2 + {_sigma('spot_rv_300', h)} ** 2), 4) AS gap_z_{h}" for h in _H)},
               CASE WHEN perp_shock_300 IS NULL THEN 'UNKNOWN' WHEN greatest(perp_shock_300, perp_shock_900, spot_shock_300, spot_shock_900) >= 2.5 THEN 'EXTREME'
                    WHEN greatest(perp_shock_300, perp_shock_900, spot_shock_300, spot_shock_900) >= 1.5 THEN 'HIGH'
                    WHEN greatest(perp_shock_300, perp_shock_900, spot_shock_300, spot_shock_900) < 0.5 THEN 'LOW' ELSE 'NORMAL' END AS vol_regime,
               binary_ok AND pair_ok AND coalesce(perp_ok, false) AND has_mid AND has_index AS ready
        FROM derived),
    leveled AS (
        SELECT *, CASE WHEN vol_regime IN ('LOW', 'NORMAL') THEN 0 WHEN vol_regime = 'HIGH' THEN 1 WHEN vol_regime = 'EXTREME' THEN 2 END AS v1,
               CASE WHEN abs(gap_z_60) >= 2 THEN 2 WHEN abs(gap_z_60) >= 1 THEN 1 WHEN gap_z_60 IS NOT NULL THEN 0 END AS v2,
               CASE WHEN premium_stress >= 4 THEN 2 WHEN premium_stress >= 2.5 THEN 1 WHEN premium_stress IS NOT NULL THEN 0 END AS v3,
               CASE WHEN spread_ratio >= 4 THEN 2 WHEN spread_ratio >= 2 THEN 1 WHEN spread_ratio IS NOT NULL THEN 0 END AS v4
        FROM scaled),
    features AS (
        SELECT * EXCLUDE (v1, v2, v3, v4, perp_ok), coalesce(perp_ok, false) AS perp_ok,
               CASE WHEN NOT ready THEN 'UNKNOWN' WHEN 2 IN (v1, v2, v3, v4) THEN 'UNSTABLE'
                    WHEN len(list_filter([v1, v2, v3, v4], lambda x: x = 1)) >= 2 THEN 'UNSTABLE' WHEN len(list_filter([v1, v2, v3, v4], lambda x: x = 1)) = 1 THEN 'CAUTION'
                    WHEN v1 IS NULL OR v2 IS NULL OR v3 IS NULL OR v4 IS NULL THEN 'UNKNOWN' ELSE 'STABLE' END AS stability,
               CASE WHEN NOT ready THEN 'NOT_ANALYSIS_READY' ELSE concat_ws(';',
                    CASE WHEN v1 IS NULL THEN 'VOL_UNKNOWN' WHEN v1 = 1 THEN 'VOL_HIGH' WHEN v1 = 2 THEN 'VOL_EXTREME' END,
                    CASE WHEN v2 IS NULL THEN 'AGREEMENT_UNKNOWN' WHEN v2 = 1 THEN 'SPOT_PERP_DIVERGING' WHEN v2 = 2 THEN 'SPOT_PERP_DISAGREE' END,
                    CASE WHEN v3 IS NULL THEN 'PREMIUM_UNKNOWN' WHEN v3 = 1 THEN 'PREMIUM_ELEVATED' WHEN v3 = 2 THEN 'PREMIUM_EXTREME' END,
                    CASE WHEN v4 IS NULL THEN 'SPREAD_UNKNOWN' WHEN v4 = 1 THEN 'SPREAD_WIDENING' WHEN v4 = 2 THEN 'SPREAD_BLOWOUT' END) END AS reasons,
               concat_ws(';', CASE WHEN NOT binary_ok THEN 'BINARY_NOT_OK' END, CASE WHEN snapshot_id IS NULL THEN 'NO_PRIOR_PERP' END,
                    CASE WHEN snapshot_id IS NOT NULL AND NOT pair_ok THEN 'PERP_TOO_OLD' END, CASE WHEN pair_ok AND source_status = 'error' THEN 'PERP_SOURCE_ERROR' END,
                    CASE WHEN pair_ok AND source_status <> 'error' AND NOT perp_ok THEN 'PERP_STALE' END, CASE WHEN pair_ok AND source_status <> 'error' AND NOT perp_ok AND index_age_s * {S} + lag_us > {15 * S} THEN 'INDEX_STALE' END, CASE WHEN pair_ok AND source_status <> 'error' AND NOT has_mid THEN 'NO_TWO_SIDED_BOOK' END,
                    CASE WHEN pair_ok AND source_status <> 'error' AND NOT has_index THEN 'MISSING_INDEX' END,
                    CASE WHEN perp_ok AND spread IS NOT NULL AND spread_median IS NULL THEN 'INSUFFICIENT_SPREAD_BASELINE' END,
                    CASE WHEN perp_ok AND premium IS NOT NULL AND premium_z_5m IS NULL AND premium_z_5m_flat = 0 THEN 'INSUFFICIENT_5M_HISTORY' END, CASE WHEN perp_ok AND premium_z_5m_flat = 1 THEN 'PREMIUM_ZERO_VARIANCE' END,
                    CASE WHEN perp_ok AND premium IS NOT NULL AND premium_z_15m IS NULL AND premium_z_15m_flat = 0 THEN 'INSUFFICIENT_15M_HISTORY' END, CASE WHEN perp_ok AND premium_z_5m_flat = 0 AND premium_z_15m_flat = 1 THEN 'PREMIUM_ZERO_VARIANCE' END,
                    CASE WHEN perp_ok AND funding_rate IS NULL THEN 'FUNDING_MISSING' END,
                    {_horizons("CASE WHEN (perp_ok AND perp_ret_{h} IS NULL) OR spot_ret_{h} IS NULL THEN 'INSUFFICIENT_{h}S_HISTORY' END")},
                    CASE WHEN (perp_ok AND (perp_rv_60 IS NULL OR perp_rv_300 IS NULL OR perp_rv_900 IS NULL)) OR spot_rv_60 IS NULL OR spot_rv_300 IS NULL OR spot_rv_900 IS NULL THEN 'RV_INSUFFICIENT' END,
                    CASE WHEN perp_rv_300 < 0.01 OR spot_rv_300 < 0.01 THEN 'VOL_NORM_DENOMINATOR_TOO_SMALL' END) AS flags
        FROM leveled)"""

ALL = ", ".join([SQL["ticks"], SQL["snapshots"], SQL["spots"], PERP, SPOT, PAIR, CAUSAL])


def features(body: str) -> str:
    return f"WITH {ALL} {body}"
