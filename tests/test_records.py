"""Texts and times, files that are replaced as a whole, symbols, and checks before analysis."""

import datetime as dt
import hashlib
import json
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import text as T
from tidemark.operators import catalog as K
from tidemark.operators import integrity as I
from tidemark.operators import policy as P
from tidemark.operators import trading as Y
from tidemark.sources import files, formats


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_times_do_not_depend_on_the_session(spark, zone):
    texts = ["2026-03-08T06:59:59Z", "2026-03-08T07:00:00.5+00:00", "2026-11-01T08:00:00+02:00", "2026-01-02", "2026-01-02 03:04", "1969-12-31T23:59:59Z", "2026-13-01T00:00:00Z", "soon", "", None]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        us = T.iso_micros(F.col("s"))
        rows = spark.createDataFrame([(s,) for s in texts], "s string").select("s", us.alias("us"), T.iso_text(us).alias("back"), T.local_hour(us).alias("hour")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for r in rows:
        try:
            at = dt.datetime.fromisoformat(r.s)
        except (TypeError, ValueError):
            assert r.us is None and r.back is None and r.hour is None
            continue
        at = at.replace(tzinfo=dt.UTC) if at.tzinfo is None else at.astimezone(dt.UTC)
        assert r.us == round(at.timestamp() * 1e6) and r.back == at.isoformat()
        assert r.hour == at.astimezone(zoneinfo.ZoneInfo("America/New_York")).hour


def test_durations_flags_seeds_and_documents(spark):
    days = {"48h": 2, "10d": 10, " 2W ": 14, "3m": 90, "7": 7, "1.5d": 1.5, "": 30, "d": 30, "soon": 30, "1d2": 30, None: 30}
    got = spark.createDataFrame([(s,) for s in days], "s string").select("s", T.duration_days(F.col("s")).alias("d")).collect()
    assert {r.s: r.d for r in got} == days
    r = one(spark, flags=T.distinct_flags(F.lit("B;A;B;;A")), none=T.distinct_flags(F.lit("")), seed=T.derived_seed(F.lit(7), F.lit("BTC")), doc=T.canonical_row("id"))
    assert (r.flags, r.none) == ("B;A", "") and r.doc == '{"id":0}'
    assert r.seed == int(hashlib.sha256(b"7|BTC").hexdigest()[:12], 16)
    document = {"b": [1, None], "a": {"d": 0.5, "c": "é"}}
    assert T.canonical_json(document) == json.dumps(document, sort_keys=True, separators=(",", ":"))
    assert T.document_sha256(document) == T.document_sha256(dict(reversed(document.items())))


def test_prices_of_books(spark):
    cases = [(None, 60.0, 60.0), (50.0, 60.0, 51.0), (59.0, 60.0, 59.0), (58.5, 60.0, 59.5), (None, None, None), (50.0, None, None)]
    rows = spark.createDataFrame(cases, "b double, a double, want double")
    assert all(r.got == r.want for r in rows.select("want", M.resting_price(F.col("b"), F.col("a")).alias("got")).collect())
    r = one(spark, missing=M.other_ask(F.lit(None), F.lit(30.0)), given=M.other_ask(F.lit(65.0), F.lit(30.0)), margin=M.expected_margin(F.lit(90.0), F.lit(80.0), F.lit(None)), free=M.expected_margin(F.lit(90.0), F.lit(0.0), F.lit(None)))
    assert (r.missing, r.given, r.free) == (70.0, 65.0, 0.0) and r.margin == pytest.approx((0.9 * 20 - 0.1 * (80 - 56)) / 80 * 100)
    r = one(spark, new=M.fresh_when_received(F.lit("fresh"), F.lit(10), F.lit(5), 5), old=M.fresh_when_received(F.lit("fresh"), F.lit(11), F.lit(5), 5), timeless=M.fresh_when_received(F.lit("fresh"), F.lit(11), F.lit(None), 5), error=M.fresh_when_received(F.lit("error"), F.lit(5), F.lit(5), 5))
    assert tuple(r) == (True, False, True, False)


def test_symbols(spark):
    listing = [("BTCPERP", "active"), ("xbtcPERP", "active"), ("ETHPERP1", "active"), ("ETHPERP2", "active"), ("SOL", "closed"), (None, "active"), ("PXRPPERP", None)]
    got = formats.resolve_symbols(spark.createDataFrame(listing, "symbol string, status string"), ["BTC", "ETH", "SOL", "XRP", "DOGE"], {"SOL": "MINE"}, prefix="P").collect()
    assert {r.coin: (r.symbol, r.reason, r.candidates) for r in got} == {"BTC": ("BTCPERP", None, 1), "ETH": (None, "AMBIGUOUS", 2), "SOL": ("MINE", None, 1), "XRP": ("PXRPPERP", None, 1), "DOGE": (None, "NO_MARKET", 0)}
    none = formats.resolve_symbols(spark.createDataFrame([], "symbol string, status string"), ["BTC"], {})
    assert [tuple(r) for r in none.collect()] == [("BTC", None, "NO_MARKET", 0)]


def test_tables_and_documents_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "labels")
    for n in (5, 9):
        files.rewrite(spark.range(n).select((-F.col("id")).alias("id")), path, ["id"])
    files.rewrite(spark.read.parquet(path).where("id < -3"), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [-8, -7, -6, -5, -4]
    assert [p.name for p in tmp_path.iterdir()] == ["labels"]
    state = str(tmp_path / "state.json")
    assert files.load_document(spark, state, {"n": 0}) == {"n": 0}
    for n in (1, 2):
        files.save_document(spark, state, {"n": n, "a": ["é\n"]})
    assert files.load_document(spark, state) == {"n": 2, "a": ["é\n"]}
    (tmp_path / "bad.json").write_text("{")
    assert files.load_document(spark, str(tmp_path / "bad.json"), 3) == 3


def test_rows_of_another_layout_are_rotated(spark, tmp_path):
    path = str(tmp_path / "trades")
    assert files.append_rows(spark.range(2), path) is None and files.append_rows(spark.range(3), path) is None
    aside = files.append_rows(spark.range(4).withColumn("price", F.lit(1)), path)
    assert spark.read.parquet(aside).count() == 5 and spark.read.parquet(path).count() == 4
    report = str(tmp_path / "report")
    files.write_report(spark.createDataFrame([("a", ["x", "y"], None)], "k string, l array<string>, v double"), report, {"k": "key"})
    assert {r.value for r in spark.read.text(report).collect()} == {"a,x;y,", "key,l,v"}


def test_causal_rule(spark):
    ms = 1000
    cases = [
        ((True, 100 * ms, 99 * ms, 100 * ms, ms), None), ((True, 100 * ms, 101 * ms, 100 * ms, -ms), None), ((True, 100 * ms, 102 * ms, 100 * ms, -2 * ms), "SNAPSHOT_AFTER_SPOT"),
        ((True, 100 * ms, 90 * ms, 102 * ms, 10 * ms), "FEATURE_END_AFTER_SPOT"), ((True, 100 * ms, 100 * ms, 100 * ms, -2 * ms), "NEGATIVE_LAG"), ((True, 100 * ms, 90 * ms, 100 * ms, 13 * ms), "LAG_INCONSISTENT"),
        ((True, 100 * ms, None, 100 * ms, 1), "MISSING_TIMESTAMP"), ((False, 100 * ms, None, 100 * ms, 1), None),
    ]
    rows = spark.createDataFrame([(i, *c, want) for i, (c, want) in enumerate(cases)], "i int, ready boolean, s long, p long, e long, l long, want string")
    reason = I.causal_violation(*(F.col(x) for x in ("ready", "s", "p", "e", "l")))
    assert all(r.got == r.want for r in rows.select("want", reason.alias("got")).collect())
    with pytest.raises(I.CausalInvariantError, match="5 ready rows"):
        I.check_causal(rows, reason, ["i"])
    assert I.check_causal(rows.where("want IS NULL"), reason, ["i"]).count() == 3


def test_catalog():
    assert K.family("gap_z_60") == "directional" and K.family("spread") == "reliability" and K.family("funding_rate") == "exploratory"
    assert K.spot_controls("gap_z_60") == ["spot_z_60"] and K.spot_controls("perp_ret_30") == ["spot_ret_30"] and K.spot_controls("perp_shock_900") == ["spot_shock_900"]
    assert K.spot_controls("premium", 0.8) == ["spot_ret_60", "spot_shock_300"] and K.spot_controls("premium", 0.79) == K.spot_controls("premium") == ["spot_ret_60"]
    assert all(set(K.spot_controls(f, 1.0)) <= set(K.CONTROLS) for f in K.CANDIDATES)
    for bad in ("outcome", "pnl_30"):
        with pytest.raises(ValueError):
            K.check_predictor(bad)


def test_first_signals_off_by_more_than_a_millisecond(spark):
    rows = spark.createDataFrame([(i, 1_000_000, 0.5, 0.5, 0.0, "ALLOW", "ALLOW") for i in range(4)], "ticker long, us long, p_b double, p_c double, conflict double, decision string, reason string")
    expected = spark.createDataFrame([(0, 1_001_000), (1, 1_001_001), (2, None)], "ticker long, expected_us long")
    got = {r.ticker: (r.verified, r.decision, r.conflict) for r in P.verify_first(rows, expected).collect()}
    assert got == {0: (True, "ALLOW", 0.0), 1: (False, "UNAVAILABLE", None), 2: (None, "ALLOW", 0.0), 3: (None, "ALLOW", 0.0)}


def test_crossings_of_a_strike(spark):
    closes = [1.0, 3.0, 2.0, 1.0, 2.0, 3.0, 1.0] * 5
    rows = spark.createDataFrame([("BTC", i, c, 2.0) for i, c in enumerate(closes)], "coin string, t int, close double, strike double")
    got = {r.t: r.crossings for r in Y.recent_crossings(rows, "coin", "t").collect()}
    for i in range(len(closes)):
        last = closes[max(0, i - 15) : i + 1]
        assert got[i] == sum((b > 2 and a <= 2) or (b < 2 and a >= 2) for a, b in zip(last, last[1:]))
