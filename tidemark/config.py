"""Fixed values of the market analytics.  Times are in seconds of market time unless named otherwise."""

from __future__ import annotations

COINS = ("BTC", "ETH", "SOL", "XRP")
HORIZONS = (30, 60, 180)
TOLERANCE = 10
MAX_LAG = 8
STALE = 15
#: name: (window, least points, least span)
Z_WINDOWS = {"5m": (300, 20, 240), "15m": (900, 60, 720)}
#: window: (least points, least span); largest gap inside
RV_WINDOWS = {60: (6, 45), 300: (25, 225), 900: (75, 675)}
RV_GAP = 20
SPREAD_WINDOW, SPREAD_MIN_N, SPREAD_MIN_SPAN = 300, 20, 240
ZERO_VARIANCE = 1e-12
MIN_VOL_BPS = 0.01
NORM_WINDOW = 300
REGIME_LOW, REGIME_HIGH, REGIME_EXTREME = 0.5, 1.5, 2.5
REGIMES = ("LOW", "NORMAL", "HIGH", "EXTREME", "UNKNOWN")
GAP_Z, PREMIUM_STRESS, SPREAD_RATIO = (1.0, 2.0), (2.5, 4.0), (2.0, 4.0)

#: Rows and age of a coin's history, and how long a re-scale of its contract is flagged.
HISTORY_ROWS, HISTORY_AGE, RESCALE_FLAG = 600, 1800, 1080

HORIZON_MINUTES = (8, 6, 4, 2)
HORIZON_EARLY = 10
ENTRY_MINUTES = (2, 8)
FOLD_BOUNDS = (0.40, 0.55, 0.70, 0.85, 1.0)
MIN_TRAIN, MIN_TEST, MIN_COIN_ROWS = 30, 10, 10
SEED = 20260919
CALIBRATION_BINS = 10
CLAMP = 1e-6
RIDGE, MAX_STEPS, STEP_TOLERANCE = 1e-4, 100, 1e-9
#: Control of each lead/lag horizon, and the features screened at all of them.
LEADLAG_CONTROL = {10: "spot_ret_30", 30: "spot_ret_30", 60: "spot_ret_60", 120: "spot_ret_180"}
LEADLAG_FEATURES = ("perp_ret_30", "perp_ret_60", "perp_ret_180", "gap_30", "gap_60", "gap_180", "premium", "premium_change_30", "premium_change_60", "premium_change_180", "perp_z_60", "gap_z_60")
LEADLAG_REPS, THRESHOLD_REPS = 1000, 2000
LEADLAG_HORIZONS, LEADLAG_TOLERANCE, LEADLAG_GAP = (10, 30, 60, 120), 8, 30

QUANTILES = (5, 10, 15, 20, 25)
ALPHAS = (0.25, 0.5, 0.75, 1.0)
DELTA_CAP = 0.05
CONF_MIN, PRICE_MIN, ENTRY_COST, CHOP_LIMIT = 80.0, 85.0, 2.0, 3
VOL_LOOKBACK, VOL_MIN, VOL_MULT = 60, 20, 1.15
STOPS = {"BTC": 0.75, "ETH": 0.60, "SOL": 0.75, "XRP": 0.65}
MARKET_SECONDS = 900
SETTLE_WAIT, SETTLE_GIVE_UP = 20, 1800
#: A call is made at most a market's length before its close.
SETTLE_REACH = MARKET_SECONDS + SETTLE_GIVE_UP
GATE_WINDOW, GATE_MIN, GATE_MAX_BLOCK, GATE_MAX_OPEN, GATE_ERRORS = 50, 30, 0.35, 0.50, 3

#: Seconds of the events table to a second of market time: its smallest useful table is about a thousand times sparser than
#: a live feed.  Fixed, so that a row's features never depend on how many rows there are.
TIME_SCALE = 1000
