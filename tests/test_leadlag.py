"""The lead/lag screen on planted anchors, and the bootstrap's draws."""

import numpy as np

from tidemark import config as C
from tidemark.operators import models as Z
from tidemark.plans import modeling


def test_every_horizon_and_feature(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    rng, frames = np.random.default_rng(4), []
    controls = sorted(set(C.LEADLAG_CONTROL.values()))
    for h in C.LEADLAG_HORIZONS:
        n = 500
        f = pd.DataFrame({c: rng.normal(size=n) for c in (*C.LEADLAG_FEATURES, *controls)})
        f["us"] = np.arange(n) * 200_000_000
        f["label_us"], f["horizon"], f["event_id"] = f["us"] + h * 1_000_000, h, np.arange(n)
        f["coin"] = np.where(np.arange(n) % 10 < 8, "BTC", "ETH")
        f["y"] = f[C.LEADLAG_CONTROL[h]] + (f["gap_180"] if h == 120 else 0) + 0.1 * rng.normal(size=n)
        frames.append(f)
    anchors = spark.createDataFrame(pd.concat(frames)).withColumn("horizon", F.col("horizon").cast("int"))
    rows = modeling.leadlag_screen(anchors, 1).collect()
    got = {(r.grp, r.horizon, r.feature): r for r in rows}
    assert len(rows) == len(got) == 5 * 4 * 12
    for (grp, h, feature), r in got.items():
        if grp in ("ETH", "SOL", "XRP"):
            assert r.status == "INSUFFICIENT" and r.n_anchors == (100 if grp == "ETH" else 0) and r.mse_base is None
        elif (h, feature) == (120, "gap_180"):
            assert r.status == "SIGNAL" and r.valid_folds == 4 and r.r2_with_feature > 0.9 > r.r2_base and r.ci_low > 0 and r.q_value <= 0.05
            assert r.p_value < 1 / 900
        else:
            assert r.status == "NO_SIGNAL" or r.mse_gain < 0.001, r
            assert h == 120 or r.r2_base > 0.9  # the horizon's own control


def test_draws_are_the_same_in_numpy(spark):
    from pyspark.sql import functions as F

    ids = [0, 7, 123456789, 2**40]
    rows = spark.createDataFrame([(i, r) for i in ids for r in range(1, 51)], "i long, r long")
    rows = rows.select("i", "r", Z.poisson_weight(C.SEED, F.col("i"), F.col("r")).alias("w")).collect()
    w = Z._poisson_weights(C.SEED, np.array(ids)[:, None], np.arange(1, 51))
    assert all(w[ids.index(r.i), r.r - 1] == r.w for r in rows)


def test_later_rows_are_found_without_lists(spark):
    """Crowded times with ties and gaps: the nearest later row of each horizon equals a plain search, in flat numbers only."""
    from tidemark.operators import cohorts

    rng = np.random.default_rng(8)
    us = np.sort(rng.integers(0, 400, 600)) * 1_000_000 // 2
    run = np.cumsum(np.concatenate(([0], np.diff(us) > 1_500_000)))
    rows = [(1, "BTC", i, int(t), float(rng.integers(90, 110)), int(r), bool(rng.random() < 0.8)) for i, (t, r) in enumerate(zip(us, run))]
    df = spark.createDataFrame(rows, "session long, coin string, event_id long, us long, spot double, run long, ready boolean")
    found = cohorts.nearest_later(df, ["session", "coin"], (1, 5, 10), 3, 1_000_000)
    assert not [k for _, k in found.dtypes if k.startswith("array")]
    got = {(r.event_id, r.horizon): (r.label_us, r.later) for r in found.collect()}
    expected = {}
    for _, _, i, t, _, r, ready in rows:
        for h in (1, 5, 10):
            near = [(abs(u - t - h * 1_000_000), u, s) for _, _, _, u, s, q, _ in rows if q == r and t + max(1, (h - 3) * 1_000_000) <= u <= t + (h + 3) * 1_000_000]
            if ready and near:
                expected[i, h] = min(near)[1:]
    assert got == expected and len(got) > 500
