"""Scans over buckets against loops over whole groups, with buckets of a few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts, ordered, scans, trading


@pytest.fixture(params=[5, 64, 100_000])
def bucket(request, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", request.param)
    return request.param


def plain_rsi(closes, n=14):
    """Wilder's RSI, its place among the last n and the arrow, each None until there are enough closes."""
    steps = [b - a for a, b in zip(closes, closes[1:])]
    rsi = [None] * len(closes)
    for i in range(n, len(closes)):
        if i == n:
            up, down = sum(max(x, 0) for x in steps[:n]) / n, sum(max(-x, 0) for x in steps[:n]) / n
        else:
            up, down = (up * (n - 1) + max(steps[i - 1], 0)) / n, (down * (n - 1) + max(-steps[i - 1], 0)) / n
        rsi[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    out, before = [], None
    for i, r in enumerate(rsi):
        last = [x for x in rsi[max(0, i - n + 1) : i + 1] if x is not None]
        place = arrow = None
        if len(last) == n:
            low, high = min(last), max(last)
            place = 100 * (r - low) / (high - low) if high > low else 50.0
            arrow = None if before is None else "UP" if round(place, 9) >= round(before, 9) else "DOWN"
        before = place
        out.append((r, place, arrow))
    return out


def test_rsi(spark, bucket):
    rng, rows, want = random.Random(2), [], {}
    for coin, n in (("BTC", 300), ("ETH", 40), ("SOL", 10), ("XRP", 15)):
        closes = [100.0]
        for i in range(n - 1):
            closes.append(closes[-1] + (0 if coin == "ETH" and i < 35 else rng.choice((-1.5, -1, 0, 0.5, 1))))
        rows += [(coin, 60 * i, c) for i, c in enumerate(closes)]
        want |= {(coin, 60 * i): x for i, x in enumerate(plain_rsi(closes))}
    rng.shuffle(rows)
    found = trading.wilder_rsi(spark.createDataFrame(rows, "coin string, t long, close double")).collect()
    assert len(found) == len(rows)
    for r in found:
        rsi, place, arrow = want[r.coin, r.t]
        assert r.rsi == (None if rsi is None else pytest.approx(rsi, abs=1e-9)) and (r.stoch is None) == (place is None) and r.arrow == arrow
        assert place is None or r.stoch == pytest.approx(place, abs=1e-6)


def test_linear_scan_keeps_the_state_between_buckets(spark, bucket):
    rng = random.Random(4)
    rows = [(g, i, rng.choice((0.0, 0.5, 1.0, 0.9)), rng.random(), f"x{i}") for g in "ab" for i in range(57)]
    table = spark.createDataFrame(rows, "g string, i long, a double, b double, note string").withColumn("bucket", F.floor(F.col("i") / ordered.BUCKET).cast("long"))
    got = {(r.g, r.i): r for r in scans.linear_scan(table, ["g"], "a", ["b"]).collect()}
    for g in "ab":
        x = 0.0
        for _, i, a, b, note in (r for r in rows if r[0] == g):
            x = a * x + b
            assert got[g, i].b == pytest.approx(x, abs=1e-12) and got[g, i].note == note


@pytest.mark.parametrize("spacing", [1, 7, 60, 1000])
def test_thinning(spark, bucket, spacing):
    rng, rows = random.Random(spacing), []
    for s in range(3):
        t = 0
        for i in range((0, 130, 31)[s]):
            t += rng.choice((1, 1, 2, 4, 4, 30, 5000 if rng.random() < 0.02 else 3))
            rows.append((s, t, rng.random() < 0.7, i))
    table = spark.createDataFrame(rows, "session long, us long, usable boolean, n int")
    got = sorted((r.session, r.us, r.n) for r in scans.thinned(table, ["session"], "us", spacing, "usable").collect())
    want = []
    for s in range(3):
        own = [r for r in rows if r[0] == s]
        want += [(s, own[i][1], own[i][3]) for i in cohorts.thin([r[1] for r in own], spacing, [r[2] for r in own])]
    assert got == want


def test_runs_since_a_reset(spark, bucket):
    rng, rows, want = random.Random(6), [], {}
    for g in "ab":
        run = 0
        for i in range(90):
            kind = rng.choice("eeee..r") if g == "a" else rng.choice("e" * 40 + "r")
            run = 0 if kind == "r" else run + (kind == "e")
            rows.append((g, i, kind))
            want[g, i] = run
    table = spark.createDataFrame(rows, "g string, t int, kind string")
    found = scans.run_lengths(table, ["g"], ["t"], F.col("kind") == "e", F.col("kind") == "r").collect()
    assert {(r.g, r.t): r.run for r in found} == want and found[0].asDict().keys() == {"g", "t", "kind", "run"}


def test_percentiles(spark):
    rng, rows = np.random.default_rng(1), []
    for g, n in (("ALL", 4000), ("BTC", 7), ("ETH", 1), ("SOL", 0)):
        for _ in range(n):
            x = float(rng.choice([1.5, rng.normal()], p=[0.4, 0.6]))  # a value that many rows have
            rows.append((g, x, None if rng.random() < 0.1 and n > 7 else int(rng.integers(0, 5))))
    rows.append(("SOL", None, None))
    at = (0.0, 0.01, 1 / 3, 0.5, 0.95, 1.0)
    got = {(r.grp, r.column): r for r in scans.percentiles(spark.createDataFrame(rows, "grp string, x double, k int").withColumn("k", F.col("k").cast("double")), ["grp"], ["x", "k"], at).collect()}
    for (g, c), r in got.items():
        own = [row[1 + (c == "k")] for row in rows if row[0] == g and row[1 + (c == "k")] is not None]
        assert r.n == len(own) and np.allclose(r.q, np.quantile(own, at), rtol=0, atol=1e-12)
    assert set(got) == {(g, c) for g in ("ALL", "BTC", "ETH") for c in "xk"}
