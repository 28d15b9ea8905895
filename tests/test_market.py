"""Known answers of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("bid, ask, expected", [(99, 101, 200), (101, 99, None), (0, 1, None)])
def test_spread(spark, bid, ask, expected):
    assert one(spark, M.spread_bps(lit(bid), lit(ask))) == expected


def test_premium(spark):
    assert one(spark, M.premium_bps(lit(100.2), lit(100))) == pytest.approx(20)
    assert one(spark, M.premium_bps(lit(99.8), lit(100))) == pytest.approx(-20)
    assert one(spark, M.premium_bps(lit(0), lit(100))) is None


def test_normalized(spark):
    assert one(spark, M.normalized_return(lit(12), lit(7.5), 60)) == pytest.approx(1.6)
    assert one(spark, M.normalized_gap(lit(10), lit(3), lit(4), 60)) == pytest.approx(2)
    assert one(spark, M.normalized_gap(lit(10), lit(3), lit(4), 240)) == pytest.approx(1)


@pytest.mark.parametrize("x, name", [(0.4999, "LOW"), (0.5, "NORMAL"), (1.4999, "NORMAL"), (1.5, "HIGH"), (2.4999, "HIGH"), (2.5, "EXTREME"), (None, "UNKNOWN")])
def test_regime(spark, x, name):
    assert one(spark, M.vol_regime(lit(x), lit(None), lit(None), lit(None))) == name


def test_regime_takes_the_largest(spark):
    assert one(spark, M.vol_regime(lit(None), lit(3), lit(3), lit(3))) == "UNKNOWN"
    assert one(spark, M.vol_regime(lit(1), lit(None), lit(2.6), lit(None))) == "EXTREME"


@pytest.mark.parametrize("args, state", [(("HIGH", 0, 0, 2.0), "UNSTABLE"), (("NORMAL", -1, 0, 1), "CAUTION"), (("NORMAL", None, 2.5, None), "CAUTION"), (("LOW", 0, 0, 1), "STABLE"), (("LOW", None, 0, 1), "UNKNOWN")])
def test_stability(spark, args, state):
    regime, *rest = args
    found, _ = M.stability(F.lit(True), F.lit(regime), *map(lit, rest))
    assert one(spark, found) == state


def test_fee_and_sizes(spark):
    assert one(spark, M.fee_cents(lit(90), F.lit(0))) == 0
    assert one(spark, M.fee_cents(lit(50), F.lit(1))) == 2
    assert one(spark, M.kelly_fraction(lit(80), lit(90))) == 0
    assert one(spark, M.kelly_fraction(lit(99), lit(60))) == pytest.approx(0.05)


def test_overlay(spark):
    p = M.blend(lit(0.93), M.overlay_delta(lit(0.90), lit(0.70)), lit(0.25))
    assert one(spark, p) == pytest.approx(0.9425)
    for args, decision in (((0.49, "UP", 85), "DIRECTION_FLIP"), ((0.79, "UP", 70), "LOW_CONFIDENCE"), ((0.90, "UP", 88), "NO_EDGE"), ((0.93, "UP", 88), "ALLOW")):
        assert one(spark, M.overlay_decision(lit(args[0]), F.lit(args[1]), lit(args[2]), F.lit(True))) == decision


def test_norm_cdf(spark):
    for x in (-3, -0.5, 0, 0.1, 2):
        assert one(spark, M.norm_cdf(lit(x))) == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=2e-7)


def test_finite(spark):
    rows = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), ("",), (None,)], "v string").select(M.finite(F.col("v")).alias("x")).collect()
    assert [r.x for r in rows] == [1.5, None, None, None, None, None]
