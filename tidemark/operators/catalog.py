"""Which features may be screened, of what family they are and which spot controls go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families of features, by name.
_H = (30, 60, 180)
BASIS = ("premium", "mark_premium", "last_premium", "mid_mark_basis", *(f"premium_change_{h}" for h in _H), "premium_z_5m", "premium_z_15m")
DIRECTIONAL = (*BASIS, *(f"perp_ret_{h}" for h in _H), *(f"gap_{h}" for h in _H), *(f"perp_z_{h}" for h in _H), *(f"gap_z_{h}" for h in _H))
RELIABILITY = ("spread", "perp_rv_60", "perp_rv_300", "perp_rv_900", "perp_shock_300", "perp_shock_900", "spread_ratio", "premium_stress")
EXPLORATORY = ("funding_rate",)
CONTROLS = (*(f"spot_ret_{h}" for h in _H), "spot_rv_60", "spot_rv_300", "spot_rv_900", "spot_shock_300", "spot_shock_900", *(f"spot_z_{h}" for h in _H))
CANDIDATES = (*DIRECTIONAL, *RELIABILITY, *EXPLORATORY)
LABEL_WORDS = ("outcome", "settle", "result", "win", "pnl", "exit", "future", "label")
SECOND_CONTROL, SECOND_COVERAGE = "spot_shock_300", 0.80
FAMILIES = {"directional": DIRECTIONAL, "reliability": RELIABILITY, "exploratory": EXPLORATORY}


def check_predictor(name: str) -> str:
    """The name, if it is on the list and does not look like a label; else an error."""
    if name not in CANDIDATES and name not in CONTROLS:
        raise ValueError(f"{name} is not a predictor on the list")
    if any(word in name.lower() for word in LABEL_WORDS):
        raise ValueError(f"{name} looks like a label")
    return name


def family(name: str) -> str:
    for kind, names in FAMILIES.items():
        if name in names:
            return kind
    raise ValueError(f"{name} has no family")


def spot_controls(name: str, second_coverage: float | None = None) -> list[str]:
    """The spot columns that must not explain the feature away.

    Features of premium and basis get a second one if ``second_coverage``, the share of their usable rows that have it,
    is 0.8 or more.
    """
    if name in (*BASIS, *EXPLORATORY):
        extra = second_coverage is not None and second_coverage >= SECOND_COVERAGE
        return ["spot_ret_60", SECOND_CONTROL] if extra else ["spot_ret_60"]
    if name in ("spread", "spread_ratio", "premium_stress"):
        return [SECOND_CONTROL]
    if family(name) == "reliability":
        return ["spot_" + name.removeprefix("perp_")]
    scaled = "_z_" in name
    return [("spot_z_" if scaled else "spot_ret_") + name.rsplit("_", 1)[1]]


def blank_reason(name: str) -> Column:
    """Why a normalised feature is blank, told from the row's other columns; null where it is not blank."""
    kind, last = name.split("_", 1)[0], name.rsplit("_", 1)[-1]
    blank = lambda c: F.col(c).isNull()
    steps: list[tuple[Column, str]] = [] if kind == "spot" else [(~F.col("perp_ok"), "PERP_SNAPSHOT_NOT_USABLE")]
    if kind != "perp":
        steps.append((blank("spot"), "SPOT_UNAVAILABLE"))
    if "_z_" in name:
        if kind == "gap":
            steps.append((blank(f"gap_{last}"), f"GAP_{last}S_UNAVAILABLE"))
        else:
            steps.append((blank(f"{kind}_ret_{last}"), f"{kind.upper()}_{last}S_RETURN_WARMUP_OR_GAP"))
        steps += [(blank(f"{s}_rv_300"), f"{s.upper()}_RV300_WARMUP_OR_GAP") for s in ("perp", "spot") if kind in ("gap", s)]
        rest = "RV300_BELOW_NUMERICAL_FLOOR"
    elif name == "premium_stress":
        rest = "PREMIUM_Z_5M_WARMUP_OR_ZERO_VARIANCE"
    else:
        steps += [(blank("spread"), "NO_VALID_CURRENT_SPREAD"), (blank("spread_median"), "SPREAD_BASELINE_INSUFFICIENT")]
        rest = "SPREAD_BASELINE_ZERO"
    return F.when(blank(name), F.coalesce(*(F.when(test, why) for test, why in steps), F.lit(rest)))
