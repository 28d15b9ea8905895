"""Operators against plain Python on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts, metrics, models, policy, timewin, trading
from tidemark.operators.features import perp_features, spot_features
from tidemark.sources import formats
from tidemark.sources.views import SECOND


def spots(spark, points):
    return spark.createDataFrame([(i, "BTC", int(t * SECOND), 0, float(p), True, 0) for i, (t, p) in enumerate(points)], "event_id long, coin string, us long, session long, spot double, binary_ok boolean, latency_ms long")


def plain_vol(points, end, window, least, span):
    inside = [(t, p) for t, p in points if end - window <= t <= end]
    if len(inside) < least or inside[-1][0] - inside[0][0] < span or any(b[0] - a[0] > 20 for a, b in zip(inside, inside[1:])):
        return None
    rv = sum(math.log(b[1] / a[1]) ** 2 for a, b in zip(inside, inside[1:]))
    return math.sqrt(rv * 60 / (inside[-1][0] - inside[0][0])) * 1e4


def test_spot_features_match_plain_windows_over_many_buckets(spark):
    rng, t, p, points = random.Random(3), 0.0, 100.0, []
    for _ in range(1500):
        t += rng.choice([3, 4, 4, 5, 5, 40 if rng.random() < 0.03 else 4])
        p *= math.exp(rng.gauss(0, 0.001))
        points.append((t, p))
    found = {r.event_id: r for r in spot_features(spots(spark, points), 1).collect()}
    assert len(found) == len(points)
    for i in range(0, len(points), 7):
        end, price = points[i]
        for window, (least, span) in {60: (6, 45), 300: (25, 225), 900: (75, 675)}.items():
            expected, got = plain_vol(points[: i + 1], end, window, least, span), found[i][f"spot_rv_{window}"]
            assert (got is None) == (expected is None)
            assert got is None or got == pytest.approx(expected, abs=2e-4)
        before = [(t, p) for t, p in points[: i + 1] if t <= end - 30]
        expected = (price / before[-1][1] - 1) * 1e4 if before and end - 30 - before[-1][0] <= 10 else None
        assert found[i].spot_ret_30 == (None if expected is None else pytest.approx(expected, abs=1e-4))


def test_later_values_change_no_feature(spark):
    rng = random.Random(5)
    points = [(4.0 * i, 100 + rng.random()) for i in range(400)]
    poisoned = points[:300] + [(t, p * 5) for t, p in points[300:]]
    a = {r.event_id: r for r in spot_features(spots(spark, points), 1).collect()}
    b = {r.event_id: r for r in spot_features(spots(spark, poisoned), 1).collect()}
    assert all(a[i] == b[i] for i in range(300))


def test_premium_z_edges(spark):
    rows = [(i, "BTC", i * 4 * SECOND, 0, 99.0, 101.0, 100.0 * (1 + 1e-4 * math.sin(i)), 1.0, 1.0, "fresh", 0, 0.0, 100.0, 200.0, -1e4 * math.sin(i) * 1e-4, True) for i in range(90)]
    names = "event_id long, coin string, us long, session long, bid double, ask double, index_price double, mark double, last_price double, source_status string, index_age_s long, funding_rate double, mid double, spread double, premium double, fresh boolean"
    last = {r.event_id: r for r in perp_features(spark.createDataFrame(rows, names), 1).collect()}[89]
    assert last.premium_z_5m_n == 75  # the lower edge is outside
    inside = [r[14] for r in rows[15:]]
    assert last.premium_z_5m == pytest.approx((inside[-1] - np.mean(inside)) / np.std(inside, ddof=1), abs=1e-4)
    assert last.spread_median == 200 and last.spread_n == 75 and last.spread_ratio == 1


def test_asof_is_inclusive_and_carries_over_buckets(spark):
    right = spark.createDataFrame([("a", 96), ("a", 100), ("a", 104)], "k string, t long").withColumn("v", F.col("t"))
    left = spark.createDataFrame([("a", x) for x in (90, 100, 102, 5000)] + [("b", 100)], "k string, t long")
    for width in (7, 10_000):
        got = {(r.k, r.t): r.match and r.match.v for r in timewin.asof(left, right, "k", "t", width).collect()}
        assert got == {("a", 90): None, ("a", 100): 100, ("a", 102): 100, ("a", 5000): 104, ("b", 100): None}


def test_metrics_with_known_values(spark):
    df = spark.createDataFrame([("x", 0.1, 0), ("x", 0.4, 0), ("x", 0.35, 1), ("x", 0.8, 1)], "g string, p double, up int")
    assert metrics.auc(df, ["g"]).first().auc == 0.75
    assert metrics.auc(df.withColumn("p", F.lit(0.5)), ["g"]).first().auc == 0.5
    assert metrics.auc(df.where("up = 1"), ["g"]).first().auc is None
    ece = spark.createDataFrame([("x", 0.05, 0), ("x", 0.15, 1), ("x", 0.95, 1), ("x", 0.95, 0)], "g string, p double, up int")
    assert metrics.ece(ece, ["g"]).first().ece == pytest.approx(0.45)
    assert metrics.calibration(ece, ["g"]).count() == 10
    for ps, qs in (([0.01, 0.04, 0.03, 0.005], [0.02, 0.04, 0.04, 0.02]), ([0.5, None, 0.01], [0.5, None, 0.02])):
        rows = spark.createDataFrame([("x", i, p) for i, p in enumerate(ps)], "g string, i int, p_value double")
        got = [r.q_value for r in metrics.bh_qvalues(rows, ["g"]).orderBy("i").collect()]
        assert got == [None if q is None else pytest.approx(q) for q in qs]


def test_walk_forward_keeps_keys_whole(spark):
    rng = random.Random(1)
    keys = [rng.randint(0, 300) for _ in range(1000)]
    got = {r.k: r.block for r in metrics.walk_forward(spark.createDataFrame([("x", k) for k in keys], "g string, k int"), "k", ["g"]).collect()}
    uniq, counts = sorted(set(keys)), {k: keys.count(k) for k in set(keys)}
    expected, cuts = {}, []
    for b in (0.40, 0.55, 0.70, 0.85):
        g = c = 0
        while g < len(uniq) and c < round(b * len(keys)):
            c += counts[uniq[g]]
            g += 1
        cuts.append(g)
    for i, k in enumerate(uniq):
        expected[k] = sum(i >= c for c in cuts)
    assert got == expected


def test_thinning():
    assert cohorts.thin([0, 10, 59, 60, 61, 130], 60, [True, True, True, False, True, True]) == [0, 4, 5]


def test_logistic_and_linear_fits(spark):
    rng = np.random.default_rng(2)
    rows, exact = [], {}
    for g in ("a", "b"):
        x = rng.normal(size=(400, 2))
        y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
        rows += [(g, float(a), float(b), float(v)) for (a, b), v in zip(x, y)]
        beta, design = np.zeros(3), np.c_[np.ones(400), x]
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ beta))
            beta = beta + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([0, 1e-4, 1e-4]), design.T @ (y - p) - np.array([0, 1e-4, 1e-4]) * beta)
        exact[g] = beta, np.linalg.lstsq(design, y, rcond=None)[0]
    df = spark.createDataFrame(rows, "g string, u double, v double, y double")
    fits = models.logistic_fits(df, ["g"], {"m": ["u", "v"]})
    lines = models.linear_fits(df, ["g"], {"m": ["u", "v"], "s": ["u"]})
    for g, (beta, line) in exact.items():
        assert fits[(g,)]["m"] == pytest.approx(beta, abs=1e-6)
        assert lines[(g,)]["m"] == pytest.approx(line, abs=1e-9)
    assert models.linear_fits(df.withColumn("v", F.col("u")), ["g"], {"m": ["u", "v"]}) == {}


def test_scaler_and_bootstrap(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(101)], "g string, x double")
    s = models.fit_scalers(df, ["g"], ["x"]).first().s_x
    assert (s.low, s.high) == (1, 99)
    rows = spark.createDataFrame([("g", i // 3, 0.1 + 0.01 * (i % 7)) for i in range(600)], "g string, c long, v double")
    b = models.cluster_bootstrap(rows, ["g"], "c", "v", 7).first()
    assert b.ci_low < b["mean"] < b.ci_high and b.p_value == pytest.approx(1 / (models.REPS + 1))
    w = spark.range(20000).select(F.avg(models.poisson_weight(3, F.col("id"), F.col("id") % 50)).alias("m"), F.var_pop(models.poisson_weight(3, F.col("id"), F.col("id") % 50)).alias("v")).first()
    assert w.m == pytest.approx(1, abs=0.03) and w.v == pytest.approx(1, abs=0.06)


def test_settlement(spark):
    names = "ticker int, coin string, side string, up int, entry double, stop double, contracts int, maker boolean, bid_lo double, ask_lo double, close_us long"
    rows = [(1, "BTC", "UP", 1, 90.0, 68.0, 1, False, 62.0, 80.0, 1), (2, "BTC", "UP", 1, 90.0, 68.0, 1, False, 40.0, 80.0, 1), (3, "BTC", "UP", 1, 90.0, 68.0, 1, True, 95.0, 95.0, 1), (4, "BTC", "DOWN", 0, 90.0, 68.0, 2, False, 80.0, 80.0, 1), (5, "BTC", "UP", None, 90.0, 68.0, 1, False, 80.0, 80.0, 1)]
    got = {r.ticker: (r.exit_reason, r.exit_price, r.win, r.pnl) for r in trading.settle(spark.createDataFrame(rows, names)).collect()}
    assert got[1][:3] == ("stop", 62.0, 0) and got[2][:3] == ("stop", 40.0, 0)
    assert got[3] == ("unfilled", 0.0, None, 0.0) and got[4][:3] == ("settle", 100.0, 1) and 5 not in got


def test_policy_rejects_bad_documents():
    with pytest.raises(ValueError):
        policy.Policy("p", "f", [], {"f": (0, 1, 0, 1)}, (0.0, 1.0), (0.0, 1.0, 1.0), threshold=0.1)
    with pytest.raises(ValueError):
        policy.Policy("p", "f", ["c"], {"f": (0, 1, 0, 1)}, (0.0, 1.0, 1.0), (0.0, 1.0, 1.0, 1.0), threshold=-0.1)


def test_journal_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 5), ("p", 1, 3), ("p", 2, 1)], "policy string, ticker int, us int")
    path = str(tmp_path / "journal")
    assert formats.append_new(rows, path, ["policy", "ticker"], "us") == 2
    assert formats.append_new(rows, path, ["policy", "ticker"], "us") == 0
    assert sorted(r.us for r in spark.read.parquet(path).collect()) == [1, 3]


def test_csv_versions(spark, tmp_path):
    df = spark.createDataFrame([(3, 1.5, True), (2, 2.5, False)], "v int, x double, b boolean")
    formats.write_csv(df, str(tmp_path / "t"))
    assert formats.read_csv(spark, str(tmp_path / "t"), df.schema).count() == 2
    with pytest.raises(formats.SchemaMismatch):
        formats.read_csv(spark, str(tmp_path / "t"), df.schema, {"v": "3"})
    with pytest.raises(formats.SchemaMismatch):
        formats.read_csv(spark, str(tmp_path / "t"), df.select("x", "v", "b").schema)


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_gate_latches_like_a_loop(spark, monkeypatch, bucket):
    from collections import deque

    from tidemark.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET", bucket)
    rng, rows, want = random.Random(8), [], {}
    for key, chances in (("quiet", (0.02, 0.02)), ("errors", (0.5, 0.1)), ("blocks", (0.02, 0.6)), ("killed", (0.1, 0.2))):
        window, recorded, errors, off, killed = deque(maxlen=50), {}, 0, None, False
        for i in range(160):
            r = {"coin": key, "t": i, "ticker": rng.randrange(120), "failed": rng.random() < chances[0], "late": rng.random() < 0.1, "killed": key == "killed" and i in (90, 95)}
            r["decision"] = "WOULD_BLOCK" if rng.random() < chances[1] else rng.choice(["ALLOW"] * 8 + ["UNAVAILABLE", "NOT_APPLICABLE"])
            rows.append(r)
            killed |= r["killed"]
            if killed or off:
                want[key, i] = ("INACTIVE", "KILLED" if killed else "BREAKER_" + off)
                continue
            if r["ticker"] in recorded:
                kind = recorded[r["ticker"]]
                want[key, i] = ({"BLOCK": "SUPPRESS", "OPEN": "PASS_OPEN"}.get(kind, "PASS"), "REPLAY_" + kind)
                continue
            if r["failed"]:
                errors += 1
                want[key, i] = ("PASS_OPEN", "INTERNAL")
                off = "ERRORS" if errors >= 3 else None
                continue
            if r["decision"] == "NOT_APPLICABLE":
                want[key, i] = ("PASS", "NOT_APPLICABLE")
                continue
            kind = {"WOULD_BLOCK": "BLOCK", "UNAVAILABLE": "OPEN"}.get(r["decision"], "ALLOW")
            reason = "UNAVAILABLE" if kind == "OPEN" else kind
            if kind != "OPEN":
                errors = 0
                if r["late"]:
                    errors, kind, reason = 1, "OPEN", "TIMEOUT"
            recorded[r["ticker"]] = kind
            window.append(kind)
            want[key, i] = ({"BLOCK": "SUPPRESS", "OPEN": "PASS_OPEN"}.get(kind, "PASS"), reason)
            if len(window) >= 30:
                share = {k: window.count(k) / len(window) for k in ("BLOCK", "OPEN")}
                off = "BLOCK_RATE" if share["BLOCK"] > 0.35 else "OPEN_RATE" if share["OPEN"] > 0.5 else None
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "coin string, t int, ticker int, failed boolean, late boolean, killed boolean, decision string")
    got = {(r.coin, r.t): (r.action, r.reason) for r in policy.gate_run(table, "coin", ["t"]).collect()}
    assert got == want and {"KILLED", "BREAKER_ERRORS", "BREAKER_BLOCK_RATE", "TIMEOUT", "REPLAY_BLOCK"} <= {x[1] for x in got.values()}


def test_buckets_are_given_back_in_slices(spark, monkeypatch):
    """Crowded buckets, ties included: slices of any size give what a whole bucket gives, and frames their own medians."""
    import numpy as np

    from tidemark.operators import timewin

    rng = np.random.default_rng(5)
    value = rng.normal(size=3_000)
    end = np.sort(rng.integers(0, 3_000, 500))
    first = np.minimum(np.sort(rng.integers(0, 3_000, 500)), end)
    expected = [np.median(value[a:b]) if b > a else np.nan for a, b in zip(first, end)]
    assert np.allclose(timewin.rolling_median(value, first, end), expected, equal_nan=True)
    points = [(i, (i // 3) * 250_000, 100 + float(rng.normal())) for i in range(6_000)]
    rows = spark.createDataFrame([(i, "BTC", us, 0, x, True, 0) for i, us, x in points], "event_id long, coin string, us long, session long, spot double, binary_ok boolean, latency_ms long")

    def columns(x):
        return lambda i, j: {"n": np.full(j - i, j - i), "before": np.searchsorted(x["us"], x["us"][i:j])}

    monkeypatch.setattr(timewin, "SLICE", 300)
    found = timewin.with_halo(rows, "us", 600_000_000, columns, ["us"], ["event_id", "us"], "event_id long, us long, n long, before long").collect()
    assert sorted(r.event_id for r in found) == list(range(6_000)) and max(r.n for r in found) <= 375
    assert all(r.before == r.event_id // 3 * 3 for r in found)


def test_windows_hold_no_bucket(spark, monkeypatch):
    """A crowded bucket is read in order: the windows see the lookback and the rows taken up, and give the same."""
    import numpy as np

    from tidemark.operators import timewin

    points = [(i, "AB"[i % 2], (i // 6) * 250_000) for i in np.random.default_rng(6).permutation(24_000).tolist()]
    rows = spark.createDataFrame(points, "event_id long, coin string, us long")

    def columns(x):
        us, at = x["us"], lambda t: np.searchsorted(us, t, "right")
        return lambda i, j: {"seen": np.full(j - i, len(us)), "n": at(us[i:j]) - at(us[i:j] - 250_000_000)}

    monkeypatch.setattr(timewin, "SLICE", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        found = timewin.with_halo(rows, "us", 250_000_000, columns, ["us"], ["event_id"], "event_id long, seen long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.event_id for r in found) == list(range(24_000))
    assert all(r.n == 3 * min(r.event_id // 6 + 1, 1_000) for r in found)
    assert max(r.seen for r in found) < 3_800  # 3,000 rows a lookback, 6,000 a bucket
