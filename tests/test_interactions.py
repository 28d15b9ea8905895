"""Interactions: a planted product is found, main effects alone are not taken for one, and fits equal numpy's."""

import numpy as np
import pandas as pd

from tidemark.operators import models as Z


def sample(n, product, seed):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"ticker": np.arange(n), "close_us": np.arange(n) * 900, "base_logit": rng.normal(0, 0.8, n), "c": rng.normal(size=n), "x": rng.normal(size=n), "m": rng.normal(size=n)})
    f["coin"] = "BTC"
    z = f.base_logit + 0.5 * f.x + 0.5 * f.m + 0.4 * f.c * f.m + product * f.x * f.m
    f["up"] = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    return f


def test_planted_product(spark):
    f = pd.concat([sample(1_500, 1.2, 1).assign(grp="product"), sample(1_500, 0.0, 2).assign(grp="none")])
    rows = spark.createDataFrame(f).selectExpr("grp", "ticker", "close_us", "base_logit", "c", "x", "m", "coin", "cast(up AS int) AS up", "1 AS horizon")
    found = {r.grp: r for r in Z.classify(Z.screen_interaction(rows, ["grp", "horizon"], "c", "x", "m", 300), ["grp", "horizon"]).collect()}
    assert found["product"].status == "CANDIDATE" and found["product"].sign_pct == 100 and found["product"].brier_gain > 0.02 and found["product"].ci_low > 0
    assert found["none"].status != "CANDIDATE" and abs(found["none"].brier_gain) < 0.005
    design = Z.crossed_design(rows, ["grp", "horizon"], "c", "x", "m").where("grp = 'product' AND NOT is_test AND fold = 1").toPandas()
    for c in ("zc", "zf", "zm"):
        assert abs(design[c].mean()) < 1e-9 and abs(design[c].std(ddof=0) - 1) < 1e-9
    assert np.allclose(design.zcm, design.zc * design.zm) and np.allclose(design.zfm, design.zf * design.zm)
