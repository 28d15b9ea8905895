"""Scalar functions over columns: prices, probabilities, fees, states.  Null in, null out, unless stated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config as C


def finite(x: Column) -> Column:
    """The number, or null for text that is no number and for NaN and infinities."""
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def price(x: Column) -> Column:
    return F.when(x > 0, x)


def mid(bid: Column, ask: Column) -> Column:
    """Null for a one-sided or crossed book."""
    return F.when((bid > 0) & (ask > 0) & (bid <= ask), (bid + ask) / 2)


def premium_bps(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), (a / b - 1) * 10000)


return_bps = premium_bps


def spread_bps(bid: Column, ask: Column) -> Column:
    m = mid(bid, ask)
    return (ask - bid) / m * 10000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def horizon_sigma(vol: Column, seconds: float) -> Column:
    return F.when(vol >= C.MIN_VOL_BPS, vol * math.sqrt(seconds / 60))


def normalized_return(ret: Column, vol: Column, seconds: float) -> Column:
    return ret / horizon_sigma(vol, seconds)


def normalized_gap(gap: Column, perp_vol: Column, spot_vol: Column, seconds: float) -> Column:
    return gap / F.sqrt(horizon_sigma(perp_vol, seconds) ** 2 + horizon_sigma(spot_vol, seconds) ** 2)


def spread_ratio(now: Column, base: Column) -> Column:
    return F.when((now >= 0) & (base > C.ZERO_VARIANCE), now / base)


def vol_regime(required: Column, *others: Column) -> Column:
    s = F.greatest(*(F.when(x >= 0, x) for x in (required, *others)))
    return (
        F.when(required.isNull() | (required < 0), "UNKNOWN")
        .when(s >= C.REGIME_EXTREME, "EXTREME").when(s >= C.REGIME_HIGH, "HIGH").when(s < C.REGIME_LOW, "LOW").otherwise("NORMAL")
    )


def stress_level(value: Column, bounds: tuple[float, float]) -> Column:
    v = F.abs(value)
    return F.when(v >= bounds[1], 2).when(v >= bounds[0], 1).when(v.isNotNull(), 0)


def stability_levels(regime: Column, gap_z: Column, premium_stress: Column, spread: Column) -> dict[str, Column]:
    vol = F.when(regime.isin("LOW", "NORMAL"), 0).when(regime == "HIGH", 1).when(regime == "EXTREME", 2)
    return {
        "vol": vol,
        "agreement": stress_level(gap_z, C.GAP_Z),
        "premium": stress_level(premium_stress, C.PREMIUM_STRESS),
        "spread": stress_level(spread, C.SPREAD_RATIO),
    }


#: Reason codes by component: unavailable, caution, unstable (fixed values).
REASONS = {
    "vol": ("VOL_UNKNOWN", "VOL_HIGH", "VOL_EXTREME"),
    "agreement": ("AGREEMENT_UNKNOWN", "SPOT_PERP_DIVERGING", "SPOT_PERP_DISAGREE"),
    "premium": ("PREMIUM_UNKNOWN", "PREMIUM_ELEVATED", "PREMIUM_EXTREME"),
    "spread": ("SPREAD_UNKNOWN", "SPREAD_WIDENING", "SPREAD_BLOWOUT"),
}


def stability(ready: Column, regime: Column, gap_z: Column, premium_stress: Column, spread: Column) -> tuple[Column, Column]:
    """(state, reasons joined by ;): unstable by one unstable or two cautious components."""
    levels = stability_levels(regime, gap_z, premium_stress, spread)
    count = lambda test: sum((F.when(test(x), 1).otherwise(0) for x in levels.values()), F.lit(0))
    unstable, caution, missing = count(lambda x: x == 2), count(lambda x: x == 1), count(lambda x: x.isNull())
    state = (
        F.when(~ready, "UNKNOWN").when((unstable > 0) | (caution >= 2), "UNSTABLE").when(caution == 1, "CAUTION").when(missing > 0, "UNKNOWN").otherwise("STABLE")
    )
    each = [F.when(x.isNull(), REASONS[n][0]).when(x == 1, REASONS[n][1]).when(x == 2, REASONS[n][2]) for n, x in levels.items()]
    return state, F.when(~ready, "NOT_ANALYSIS_READY").otherwise(F.concat_ws(";", *each))


def clamp_p(p: Column) -> Column:
    return F.greatest(F.lit(C.CLAMP), F.least(F.lit(1 - C.CLAMP), p))


def logit(p: Column) -> Column:
    q = clamp_p(p)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def favored(p_up: Column, side: Column) -> Column:
    return F.when(side == "UP", p_up).when(side == "DOWN", 1 - p_up)


def favored_win(up: Column, side: Column) -> Column:
    return F.when(side == "UP", up).when(side == "DOWN", 1 - up)


def norm_cdf(x: Column) -> Column:
    """Normal distribution by a rational approximation of erf (error below 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 1 - 0.5 * poly * F.exp(-z * z)
    return F.when(x >= 0, upper).otherwise(1 - upper)


def conf_side(spot: Column, strike: Column, vol: Column, minutes_left: Column) -> tuple[Column, Column]:
    """(confidence in percent, side) that the price ends above the strike."""
    z = F.log(spot / strike) / (vol * F.sqrt(F.greatest(minutes_left, F.lit(1e-4))))
    cdf = norm_cdf(z)
    return F.when(cdf >= 0.5, cdf).otherwise(1 - cdf) * 100, F.when(cdf >= 0.5, "UP").otherwise("DOWN")


def fee_cents(price_cents: Column, contracts: Column) -> Column:
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), price_cents / 100))
    return F.when(contracts <= 0, 0.0).otherwise(F.greatest(F.ceil(0.07 * contracts * p * (1 - p) * 100 - 1e-9).cast("double"), F.lit(1.0)))


def kelly_fraction(conf: Column, price_cents: Column) -> Column:
    """A quarter of the Kelly share after a two-point haircut, at most 5 %; 0 without a net edge."""
    p, cost = (conf - 2) / 100, price_cents / 100
    full = (p - cost) / (1 - cost)
    return F.when((cost > 0) & (cost < 1) & (full > 0), F.least(full / 4, F.lit(0.05))).otherwise(0.0)


def overlay_delta(p_c: Column, p_b: Column) -> Column:
    return F.greatest(F.lit(-C.DELTA_CAP), F.least(F.lit(C.DELTA_CAP), p_c - p_b))


def blend(p_base: Column, delta: Column, alpha: Column) -> Column:
    return clamp_p(clamp_p(p_base) + alpha * delta)


def overlay_decision(p_up: Column, side: Column, ask: Column, signal: Column) -> Column:
    """The first reason that applies."""
    conf = favored(p_up, side) * 100
    return (
        F.when(~signal, "NO_NEW_CALL")
        .when(conf < 50, "DIRECTION_FLIP").when(conf < C.CONF_MIN, "LOW_CONFIDENCE").when(conf - ask - C.ENTRY_COST <= 0, "NO_EDGE").otherwise("ALLOW")
    )


def other_ask(ask: Column, other_bid: Column) -> Column:
    """The ask of one side of a binary market in cents; where it is missing, what the other side's bid leaves of 100."""
    return F.coalesce(ask, 100 - other_bid)


def resting_price(bid: Column, ask: Column) -> Column:
    """Price of a resting order: one above the bid if the gap is wider than one, else the bid; without a bid the ask."""
    return F.when(bid.isNull(), ask).when(ask - bid > 1, bid + 1).when(ask.isNotNull(), bid)


def expected_margin(conf: Column, entry: Column, stop: Column) -> Column:
    """Expected profit in percent of the price; without a stop it lies at 0.7 of the price, without a price it is 0."""
    q = conf / 100
    value = q * (100 - entry) - (1 - q) * (entry - F.coalesce(stop, entry * 0.7))
    return F.when(entry > 0, value / entry * 100).otherwise(0.0)


def fresh_when_received(status: Column, received_us: Column, index_us: Column, stale_us: int) -> Column:
    """Was a snapshot fresh when it came?  An index without a time counts as fresh."""
    return (status == "fresh") & F.coalesce(received_us - index_us <= stale_us, F.lit(True))


#: Labels of the levels 0, 1 and 2 (fixed values).
LABELS = {
    "agreement": ("AGREE", "DIVERGING", "DISAGREE"),
    "premium": ("NORMAL", "ELEVATED", "EXTREME"),
    "spread": ("NORMAL", "WIDENING", "BLOWOUT"),
}


def direction(z: Column) -> Column:
    """UP or DOWN from one standard deviation on; for display only."""
    return F.when(z >= 1, "UP").when(z <= -1, "DOWN").when(z.isNotNull(), "FLAT")


def level_labels(regime: Column, gap_z: Column, premium_stress: Column, spread: Column) -> dict[str, Column]:
    levels = stability_levels(regime, gap_z, premium_stress, spread)
    return {n: F.coalesce(*(F.when(levels[n] == i, text) for i, text in enumerate(texts)), F.lit("UNKNOWN")) for n, texts in LABELS.items()}
