"""Screens lay a row out once, whatever the number of folds that it trains, and standardise it as before."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import metrics as X
from tidemark.operators import models as Z


def test_rows_are_written_once_with_the_scalers_of_their_folds(spark):
    rng, n = np.random.default_rng(5), 600
    f = pd.DataFrame({"grp": "g", "ticker": np.arange(n), "coin": np.where(np.arange(n) % 3 == 0, "ETH", "BTC"), "close_us": np.arange(n) // 4, "up": rng.integers(0, 2, n), "base_logit": rng.normal(size=n), "c": rng.normal(size=n).round(2), "x": rng.normal(size=n)})
    f.loc[::50, "x"] = None
    rows = spark.createDataFrame(f).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    design = Z.placed(rows, ["grp"], ["c", "x"])
    assert design.rows.count() == n - 12
    blocks = {r.close_us: r.block for r in X.walk_forward(rows.dropna(), "close_us", ["grp"]).collect()}
    assert sorted((r.ticker, r.block) for r in design.rows.collect()) == sorted((t, blocks[t // 4]) for t in f.dropna().ticker)
    coins = {r.cell: "ETH" if r.ticker % 3 == 0 else "BTC" for r in design.rows.collect()}
    assert {(coins[i], fold) for i, fold in design.scalers} == {(c, k) for c in ("BTC", "ETH") for k in (1, 2, 3, 4)}
    for (i, fold), s in design.scalers.items():
        train = f.dropna()[[coins[i] == c and blocks[t] < fold for c, t in zip(f.dropna().coin, f.dropna().close_us)]]
        for column, found in zip(("c", "x"), s):
            low, high = np.percentile(train[column], (1, 99))
            clipped = train[column].clip(low, high)
            assert np.allclose(found, (low, high, clipped.mean(), clipped.std(ddof=0)), rtol=0, atol=1e-9)


def test_draws_equal_plain_remainders():
    cluster, rep = np.r_[0, 1, 65537, 1000003, 2**40, np.random.default_rng(1).integers(0, 2**50, 500)][:, None], np.arange(1, 400)
    h = ((cluster % 1000003) * 7919 + rep * 104729 + 7) % Z.PRIME
    h = (h * Z.FACTOR + rep * 16807) % Z.PRIME
    h = (h * h + cluster % 65537) % Z.PRIME
    u = (h * Z.FACTOR) % Z.PRIME / float(Z.PRIME)
    below = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800.0]))
    assert (Z._poisson_weights(7, cluster, rep) == np.searchsorted(below, u, side="right")).all()


def test_blocks_by_cuts_equal_the_walk_forward_ones(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(pd.DataFrame({"g": rng.choice(["a", "b"], 700), "t": (rng.random(700) ** 3 * 40).astype(int)})).unionByName(spark.createDataFrame([("c", 9)], "g string, t long"))
    cuts = X.fold_cuts(rows.groupBy("g", "t").count().withColumnRenamed("count", "n"), "t", ["g"])
    got = {(r.g, r.t, r.block) for r in X.blocked(rows, cuts, ["g"], "t").collect()}
    assert got == {(r.g, r.t, r.block) for r in X.walk_forward(rows, "t", ["g"]).collect()}
