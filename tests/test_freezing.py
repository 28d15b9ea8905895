"""From screened features to frozen policies, against plain Python."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import freezing, models, policy
from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
COLUMNS = "ticker long, coin string, fav string, close_us long, us long, up int, base_logit double, f double, c double, grp string"


def observations(n=600, seed=5, coins=("BTC", "ETH")):
    rng, out = random.Random(seed), []
    for i in range(n):
        logit, f, c = rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(1, 0.5)
        up = int(rng.random() < 1 / (1 + math.exp(-logit - 0.8 * f)))
        out.append((i, coins[i % len(coins)], "UP" if logit > 0 else "DOWN", i // 2, i, up, logit, f, c, "ALL"))
    return out


def plain_scaler(values):
    low, high = np.percentile(values, [1, 99])
    v = np.clip(values, low, high)
    return low, high, v.mean(), v.std()


def plain_fit(x, y):
    x, beta, ridge = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, 1e-4)
    ridge[0] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
    return beta


def design(rows, scalers, reliability):
    z = np.array([[r[6], *((min(max(r[k], s[0]), s[1]) - s[2]) / s[3] for k, s in zip((8, 7), scalers[r[1]]))] for r in rows])
    return np.column_stack([z, z[:, 2] * z[:, 0]]) if reliability else z


@pytest.mark.parametrize("reliability", [False, True])
def test_final_fit_matches_numpy_and_scores_only_coins_with_scalers(spark, reliability):
    rows = [*observations(), (900, "SOL", "UP", 5, 5, 1, 0.2, 1.0, 1.0, "ALL"), (901, "BTC", "UP", 5, 5, 0, 0.1, None, 1.0, "ALL"), (902, "BTC", "UP", 999, 5, 0, 0.1, 50.0, 1.0, "ALL")]
    df = spark.createDataFrame(rows, COLUMNS)
    found = freezing.final_fit(df, "p", "f", ["c"], -0.02, reliability, cutoff_us=300)
    used = rows[:600]
    scalers = {coin: [plain_scaler(np.array([r[k] for r in used if r[1] == coin])) for k in (8, 7)] for coin in ("BTC", "ETH")}
    assert set(found.coin_scalers) == {"BTC", "ETH"}
    for coin, own in scalers.items():
        assert np.allclose([found.coin_scalers[coin][c] for c in ("c", "f")], own)
    x, y = design(used, scalers, reliability), np.array([r[5] for r in used], float)
    assert np.allclose(found.beta_b, plain_fit(x[:, :2], y), atol=1e-6)
    assert np.allclose(found.beta_c, plain_fit(x, y), atol=1e-6)
    scored = {r.ticker: r for r in policy.score(df.withColumn("ready", F.lit(True)), found).collect()}
    assert (scored[900].decision, scored[900].reason) == ("UNAVAILABLE", "SCALER_MISSING")
    assert scored[901].reason == "FEATURE_MISSING"
    p = 1 / (1 + np.exp(-(found.beta_c[0] + x @ np.array(found.beta_c[1:]))))
    assert np.allclose([scored[i].p_c for i in range(600)], p, atol=1e-9)


def test_final_fit_of_one_coin_and_of_nothing(spark):
    df = spark.createDataFrame(observations(), COLUMNS)
    found = freezing.final_fit(df, "p", "f", ["c"], -0.02, False, cutoff_us=300, group="ETH")
    assert not found.coin_scalers and set(found.scalers) == {"c", "f"} and found.group == "ETH"
    with pytest.raises(models.Singular):
        freezing.final_fit(df, "p", "f", ["c"], -0.02, False, cutoff_us=-1)
    with pytest.raises(models.Singular):
        freezing.final_fit(df.withColumn("f", F.lit(1.0)), "p", "f", ["c"], -0.02, False, cutoff_us=300)


def test_out_of_fold_conflicts_match_numpy(spark):
    rows = observations()
    found = {r.ticker: r for r in freezing.oof_conflicts(spark.createDataFrame(rows, COLUMNS), ["grp"], "c", "f", F.lit(False)).collect()}
    bounds = [round(len(rows) * b) for b in (0.40, 0.55, 0.70, 0.85, 1.0)]
    assert sorted(found) == list(range(bounds[0], len(rows)))
    for fold, (a, b) in enumerate(zip(bounds, bounds[1:]), 1):
        train, test = rows[:a], rows[a:b]
        scalers = {coin: [plain_scaler(np.array([r[k] for r in train if r[1] == coin])) for k in (8, 7)] for coin in ("BTC", "ETH")}
        x, y, t = design(train, scalers, False), np.array([r[5] for r in train], float), design(test, scalers, False)
        up = [1 / (1 + np.exp(-(beta[0] + t[:, :k] @ beta[1:]))) for k, beta in ((2, plain_fit(x[:, :2], y)), (3, plain_fit(x, y)))]
        for i, r in enumerate(test):
            b_fav, c_fav = (p[i] if r[2] == "UP" else 1 - p[i] for p in up)
            g = found[r[0]]
            assert g.fold == fold and g.win == (r[5] if r[2] == "UP" else 1 - r[5])
            assert abs(g.p_b_fav - b_fav) < 1e-6 and abs(g.conflict - (c_fav - b_fav)) < 1e-6


def test_thresholds_that_gather_losses_are_eligible_and_others_are_not(spark):
    rng = random.Random(2)
    rows = [(g, i, c, int(rng.random() < (0.3 if g == "GOOD" and c < -0.1 else 0.8))) for g in ("GOOD", "FLAT") for i in range(1200) for c in [rng.uniform(-0.15, 0.3)]]
    found = freezing.evaluate_thresholds(spark.createDataFrame(rows, "grp string, ticker long, conflict double, win int"), ["grp"], reps=300).collect()
    assert len(found) == 10
    for r in found:
        assert r.ci_low <= r.enrichment_pp <= r.ci_high and r.p_value <= r.q_value <= 1
        assert r.eligible == (r.grp == "GOOD" and r.quantile <= 10 and r.block_fraction >= 0.05) or r.quantile > 10
        if r.grp == "FLAT":
            assert "LOW_ENRICHMENT" in r.ineligible or "INTERVAL_INCLUDES_0" in r.ineligible or "Q_VALUE" in r.ineligible


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_later_signals_are_scored_by_the_policy_fitted_before(spark):
    rows = registry.queries()["prospective_scores"](spark, SF).collect()
    assert rows and {r.decision for r in rows} <= {"ALLOW", "WOULD_BLOCK", "UNAVAILABLE"}
    assert all((r.conflict is None) == (r.decision == "UNAVAILABLE") for r in rows)
