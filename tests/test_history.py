"""The snapshot history, cycles and pending calls against loops, and streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import history as H
from tidemark.operators import ordered, trading
from tidemark.sources import views as V
from tidemark.streaming import calls as S
from tidemark.streaming import cycles
from tidemark.streaming import store as S2

SECOND = V.SECOND


@pytest.mark.parametrize("bucket", [6, 100_000])
def test_admission_like_a_loop(spark, monkeypatch, bucket):
    monkeypatch.setattr(ordered, "BUCKET", bucket)
    rng, rows, want = random.Random(3), [], {}
    for coin in ("BTC", "ETH"):
        t, last, contract, known, generation, changed, history = 0, None, 1, None, 0, None, []
        for i in range(140):
            t += rng.choice((1, 4, 4, 30, -9, 0))
            contract += rng.random() < 0.05
            told = contract if rng.random() < 0.8 else None
            event = 2 * i + (coin == "ETH")
            rows.append((event, coin, t * SECOND, told))
            taken = last is None or t > last
            if taken:
                if told is not None and known is not None and told != known:
                    generation, changed, history = generation + 1, t, []
                known, last = told if told is not None else known, t
                history = [x for x in [*history, t] if x >= t - 100][-20:]
            want[event] = (taken, generation, None if changed is None else changed * SECOND, known, len(history) if taken else None)
    table = spark.createDataFrame(rows, "event_id long, coin string, us long, contract int")
    found = H.admitted(table, ["event_id"])
    lengths = {r.event_id: r.held for r in H.held(found.where("taken"), 1, 20, 100).collect()}
    got = {r.event_id: (r.taken, r.generation, r.changed_us, r.known, lengths.get(r.event_id)) for r in found.collect()}
    assert got == want and max(g for _, g, *_ in want.values()) > 2 and not all(x[0] for x in want.values())


def feed(seconds=1_600, seed=7):
    """(event_id, coin, us, px, kind, session, k) of a feed of four seconds; a coin's contract changes once."""
    rng, out, px = random.Random(seed), [], {"BTC": 100.0, "ETH": 50.0}
    for i, t in enumerate(range(0, seconds, 4)):
        for j, coin in enumerate(px):
            px[coin] *= 1 + rng.gauss(0, 5e-4)
            out.append((4 * i + 2 * j, coin, t * SECOND, px[coin], "perp", 0, 3))
            out.append((4 * i + 2 * j + 1, coin, (t + 2) * SECOND, px[coin] * (1 + rng.gauss(0, 1e-4)), "spot", 0, 3))
    return out


def split(ticks):
    contract = F.when((F.col("coin") == "ETH") & (F.col("us") >= 1_200 * SECOND), 10).otherwise(1)
    spots = V.spots(ticks).withColumn("drops", (F.col("event_id") % 90 == 1).cast("long"))
    return spots, V.snapshots(ticks, 1).withColumn("contract", contract)


SCHEMA = "event_id long, coin string, us long, px double, kind string, session long, k int"


def test_cycles_are_the_batch_and_run_again_to_the_same(spark, tmp_path):
    ticks, base = feed(), str(tmp_path / "out")
    for k in range(3):
        part = [r for r in ticks if r[2] * 3 // (1_600 * SECOND) == k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    cycles.run(stream, base, 1, split)
    rows = cycles.read(spark, base, "causal")
    got = {r.event_id: r.asDict() for r in rows.drop("batch").collect()}
    spots, snapshots = split(spark.createDataFrame(ticks, SCHEMA))
    want = {r.event_id: r.asDict() for r in feat.causal_features(spots, H.admitted(snapshots, ["event_id"]).where("taken"), 1).collect()}
    assert got == want and len(got) == 800
    legacy = {r.event_id: r.premium for r in cycles.read(spark, base, "legacy").collect()}
    assert legacy.keys() == got.keys() and any(v is not None for v in legacy.values())
    # a re-scale is flagged, and its returns do not reach over it
    flagged = [r for r in want.values() if "CONTRACT_SCALE_CHANGED" in r["flags"]]
    assert flagged and all(r["coin"] == "ETH" and r["us"] >= 1_200 * SECOND for r in flagged)
    assert all(r["perp_ret_60"] is None for r in flagged if r["us"] < 1_250 * SECOND) and any(r["perp_ret_60"] is not None for r in flagged)
    assert {e for e, r in want.items() if "QUEUE_DROPS_SINCE_PREV" in r["flags"]} == {e for e in want if e % 90 == 1}
    counters = cycles.read(spark, base, "counters").collect()
    assert sum(r.rows for r in counters) == 800 and sum(r.taken for r in counters) == 800 and {r.batch for r in counters} == {0, 1, 2}
    # the second cycle again: nothing changes
    before = {k: sorted(map(repr, cycles.read(spark, base, k).collect())) for k in cycles.KINDS}
    again = spark.createDataFrame([r for r in ticks if r[2] * 3 // (1_600 * SECOND) == 1], SCHEMA)
    cycles.run_cycle(spark, base, 1, *split(again), 1)
    spark.catalog.refreshByPath(base)
    assert {k: sorted(map(repr, cycles.read(spark, base, k).collect())) for k in cycles.KINDS} == before
    # the preview of a tick that no snapshot comes with is the row it gets then
    spot = spark.createDataFrame([(100_001, "BTC", 1_601 * SECOND, 101.5, "spot", 0, 3)], SCHEMA)
    shown = cycles.preview(spark, base, 3, split(spot)[0], 1).collect()
    assert not (tmp_path / "out" / "causal" / "batch=3").exists()
    cycles.run_cycle(spark, base, 3, *split(spot), 1)
    assert shown == cycles.read(spark, base, "causal").where("batch = 3").drop("batch").collect() and shown[0].perp_ok


def pending_cases():
    """(ticker, close, results (seen, text)) in seconds, and what becomes of each call by the end."""
    return [
        (1, 900, [(925, "yes")], ("SETTLED", 1, 925)),
        (2, 900, [(890, "no")], ("SETTLED", 0, 920)),  # known early, asked for 20 s after the close
        (3, 900, [(2700, "yes")], ("SETTLED", 1, 2700)),
        (4, 900, [(2701, "yes")], ("GAVE_UP", None, None)),
        (5, 900, [], ("GAVE_UP", None, None)),
        (6, 900, [(930, "void"), (1000, " NO "), (1100, "yes")], ("SETTLED", 0, 1000)),
        (7, 1800, [(1800, "yes"), (1805, "yes")], ("SETTLED", 1, 1820)),
    ]


def test_pending_calls(spark):
    calls = spark.createDataFrame([(k, c * SECOND) for k, c, _, _ in pending_cases()], "ticker long, close_us long")
    results = spark.createDataFrame([(k, s * SECOND, x) for k, _, seen, _ in pending_cases() for s, x in seen], "ticker long, seen_us long, result text".replace("text", "string"))
    got = {r.ticker: (r.status, r.up, None if r.settled_us is None else r.settled_us // SECOND) for r in trading.pending(calls, results, 10_000 * SECOND).collect()}
    assert got == {k: w for k, _, _, w in pending_cases()}
    early = {r.ticker: r.status for r in trading.pending(calls, results, 919 * SECOND).collect()}
    assert set(early.values()) == {"WAITING"}
    later = {r.ticker: r.status for r in trading.pending(calls, results, 990 * SECOND).collect()}
    assert later == {1: "SETTLED", 2: "SETTLED", 3: "PENDING", 4: "PENDING", 5: "PENDING", 6: "PENDING", 7: "WAITING"}


def test_pending_calls_as_a_stream(spark, tmp_path):
    cases = pending_cases()
    at = lambda s: F.timestamp_seconds(s)
    calls = spark.createDataFrame([(k, c - 300, c) for k, c, _, _ in cases], "ticker long, s long, c long").select("ticker", at("s").alias("called"), at("c").alias("close"))
    results = spark.createDataFrame([(k, s, x) for k, _, seen, _ in cases for s, x in seen], "ticker long, s long, result string").select("ticker", at("s").alias("seen"), "result")
    for low, high in ((0, 1_000), (1_000, 2_750), (2_750, 90_000)):
        some = lambda df, c: df.where((F.unix_seconds(c) >= low) & (F.unix_seconds(c) < high))  # noqa: E731,B023
        # a heartbeat moves the watermark where nothing else comes
        beat = spark.range(1).select(F.lit(-1).cast("long").alias("ticker"), at(F.lit(high - 1)).alias("t"))
        some(calls, "called").unionByName(beat.select("ticker", F.col("t").alias("called"), F.col("t").alias("close"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
        some(results, "seen").unionByName(beat.select("ticker", F.col("t").alias("seen"), F.lit("yes").alias("result"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "results"))
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = S.pending(read("calls", calls), read("results", results))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.ticker: (r.status, r.up, None if r.settled is None else int(r.settled.timestamp())) for r in spark.read.parquet(str(tmp_path / "out")).where("ticker > 0").collect()}
    assert got == {k: w for k, _, _, w in cases}


def test_store_over_several_batches(spark, tmp_path):
    rng, rows, want = random.Random(9), [], {}
    last, held = {}, {}
    for i in range(240):
        coin, us = rng.choice(("BTC", "ETH")), i * 10 + rng.choice((0, 0, -25, 3))
        rows.append((coin, i, us))
        taken = us > last.get(coin, -1 << 60)
        last[coin] = max(us, last.get(coin, us))
        held[coin] = min(50, held.get(coin, 0) + taken)
        want[i] = (taken, held[coin])
    schema = "coin string, event_id long, us long"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 80 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    S2.accepted(stream, str(tmp_path / "out"), 50)
    got = {r.event_id: (r.taken, r.held) for r in cycles.read(spark, str(tmp_path / "out"), "rows").collect()}
    assert got == want


def test_length_of_a_crowded_history(spark):
    """Far more rows within the age than a history holds: lengths equal a plain count, over buckets of rows, not of time."""
    from tidemark.operators import ordered

    n = ordered.BUCKET + 900
    rows = spark.range(n).selectExpr("id AS event_id", "'BTC' AS coin", "CAST(id >= 500 AS long) AS generation", "id * 1000 AS us")
    found = H.held(rows, 1, rows=600, age=1)
    assert found.columns == [*rows.columns, "held"]
    got = {r.event_id: r.held for r in found.collect()}
    assert got == {i: min(600, i + 1 if i < 500 else i - 499) for i in range(n)}
    few = {r.event_id: r.held for r in H.held(rows.where("event_id % 10 = 0"), 1, rows=600, age=1).collect()}
    assert few == {i: min(101, i // 10 + 1 if i < 500 else (i - 500) // 10 + 1) for i in range(0, n, 10)}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
