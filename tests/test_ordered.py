"""Sums and windows over long groups, with buckets far smaller than the groups."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered, trading


def test_sums_before(spark):
    rows = [(g, int(v), int(v) % 5) for g in "ab" for v in np.random.default_rng(1).permutation(300)]
    got = ordered.with_before(spark.createDataFrame(rows, "g string, v long, n long"), ["g"], ["v"], "n").collect()
    assert len(got) == 600 and all(r.before == sum(x % 5 for x in range(r.v)) for r in got)


def test_row_windows_do_not_depend_on_buckets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(c, i * 60, float(x), float(x) + 1, float(x) - 1) for c in ("BTC", "ETH") for i, x in enumerate(100 + np.cumsum(rng.normal(size=200)))]
    candles = spark.createDataFrame(rows, "coin string, t long, close double, high double, low double")
    whole = sorted(map(tuple, trading.indicators(candles).collect()))
    monkeypatch.setattr(ordered, "BUCKET", 23)
    assert sorted(map(tuple, trading.indicators(candles).collect())) == whole
    w = Window.partitionBy("coin").orderBy("t")
    last = candles.withColumn("m", F.avg("close").over(w.rowsBetween(-19, 0))).where("coin = 'BTC' AND t = 11940").first().m
    assert abs(next(r[4] for r in whole if r[:2] == ("BTC", 11940)) - last) < 1e-9
