"""Lead/lag anchors of crowded series: joins that stay in proportion to the rows, and features for the anchors only."""

import random

import numpy as np

from tidemark import config as C
from tidemark.operators import cohorts, features, scans
from tidemark.plans import modeling
from tidemark.sources import views as V


def joined_rows(spark, since):
    """The greatest number of rows that a join made in the executions from ``since`` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for e in list(range(since, store.executionsCount())):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_thinning_of_crowded_rows_makes_no_pairs(spark, monkeypatch):
    from tidemark.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET", 500)
    rng, times = random.Random(3), {}
    for g in "ab":  # thousands of rows, all of different times, within one spacing
        times[g] = sorted(rng.sample(range(10_000 if g == "a" else 60_000), 3000))
    rows = spark.createDataFrame([(g, t, True) for g in times for t in times[g]], "g string, us long, usable boolean")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = sorted((r.g, r.us) for r in scans.thinned(rows, ["g"], "us", 9000, "usable").collect())
    assert got == [(g, times[g][i]) for g in "ab" for i in cohorts.thin(times[g], 9000, [True] * 3000)]
    assert 0 < joined_rows(spark, since) <= 2 * 6000


def test_doors_stand_for_every_entry():
    rng = np.random.default_rng(5)
    for spacing in (1, 40, 300):
        t = np.unique(rng.integers(1000, 2000, 400))
        entry, reach = scans.doors(t, spacing, 1000)
        for begun in range(1000, 1000 + spacing):
            own = scans.kept(t, spacing, begun)
            assert reach[np.searchsorted(entry, begun)] == t[own[-1]] + spacing
            assert own.tolist() == [i + int(np.searchsorted(t, begun)) for i in cohorts.thin(t[t >= begun].tolist(), spacing, [True] * 400)]
    assert [len(x) for x in scans.doors(np.array([], np.int64), 5, 0)] == [0, 0]


def market(rng, n, second):
    """Ticks of two coins in two sessions, with gaps, ties of time and every status."""
    us = np.sort(rng.integers(0, 2400 * second, n))
    us = us[(us % (700 * second)) > 45 * second]
    us[5::50] = us[4::50][: len(us[5::50])]
    return [(i, ("BTC", "ETH")[i % 2], int(t), float(100 + rng.normal()), ("spot", "perp")[int(rng.integers(2))], int(t // (1500 * second)), int(rng.integers(1, 50))) for i, t in enumerate(us)]


def of_market(spark, rows, scale):
    ticks = spark.createDataFrame(rows, "event_id long, coin string, us long, px double, kind string, session long, k int")
    # one snapshot a time, as which of several counts is open
    perps = ticks.where("kind = 'perp'").dropDuplicates(["coin", "us"])
    return V.spots(ticks), V.snapshots(perps, scale)


def test_anchors_and_their_features_equal_those_of_all_rows(spark):
    from pyspark.sql import functions as F

    spots, snapshots = of_market(spark, market(np.random.default_rng(2), 6000, V.SECOND), 1)
    spots, snapshots = spots.localCheckpoint(), snapshots.localCheckpoint()
    ready = features.ready_rows(spots, snapshots, 1).localCheckpoint()
    whole = {r.event_id: r for r in features.causal_features(spots, snapshots, 1).collect()}
    assert {r.event_id: bool(r.ready) for r in ready.collect()} == {i: bool(r.ready) for i, r in whole.items()}
    found = cohorts.leadlag_anchors(ready, C.LEADLAG_HORIZONS, 1).localCheckpoint()
    # plainly: run by run, horizon by horizon
    expected, rows = set(), sorted(whole.values(), key=lambda r: (r.us, r.event_id))
    for key in {(r.session, r.coin) for r in rows}:
        own = [r for r in rows if (r.session, r.coin) == key]
        run = np.cumsum(np.diff([r.us for r in own], prepend=own[0].us) > C.LEADLAG_GAP * V.SECOND)
        for h in C.LEADLAG_HORIZONS:
            last = None
            for r, k in zip(own, run):
                if not r.ready or (last is not None and r.us - last < h * V.SECOND):
                    continue
                low, high = r.us + max(1, (h - C.LEADLAG_TOLERANCE) * V.SECOND), r.us + (h + C.LEADLAG_TOLERANCE) * V.SECOND
                near = [(abs(b.us - r.us - h * V.SECOND), b.us, b.spot) for b, m in zip(own, run) if m == k and low <= b.us <= high]
                if near:
                    last = r.us
                    expected.add((h, *key, r.us, r.event_id, min(near)[1], round((min(near)[2] / r.spot - 1) * 10000, 4)))
    got = {(r.horizon, r.session, r.coin, r.us, r.event_id, r.label_us, round(r.y, 4)) for r in found.collect()}
    assert got == expected and len(got) > 300 and {g[0] for g in got} == set(C.LEADLAG_HORIZONS)
    told = features.lead_features(found.select("event_id", "snapshot_id").distinct(), spots, snapshots, 1).collect()
    assert len(told) == len({g[4] for g in got}) == found.select(F.count_distinct("event_id")).first()[0]
    for r in told:
        for c in r.__fields__:
            a, b = r[c], whole[r.event_id][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 2e-4), (c, r, b)
    assert any(r.gap_z_60 is not None for r in told)


def test_anchors_need_no_trailing_features(spark, monkeypatch):
    def fails(*_, **__):
        raise AssertionError("a trailing window over all rows")

    monkeypatch.setattr(features, "perp_features", fails)
    monkeypatch.setattr(features, "spot_features", fails)
    columns = modeling.leadlag_anchors(spark, "/root/testdata/sf0.001").columns
    assert columns == ["horizon", "session", "coin", "us", "event_id", "label_us", "y"]
