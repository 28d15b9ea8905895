"""Every rule on a policy document has a document that breaks it; bindings against a loop."""

import json
import random

import pytest

from tidemark.operators import documents as D


def policy(**changes):
    scaler = {"low": -1.0, "high": 1.0, "mean": 0.0, "std": 0.5}
    p = {
        "policy_id": "p1", "policy_schema_version": 1, "mode": "shadow_only", "synthetic": False, "cohort": "first_signal", "feature_name": "gap_60", "coin_or_group": "BTC",
        "controls": ["spot_ret_60"], "reliability_interaction": False, "model_b_coefficients": [0.1, 1.0, 0.2], "model_c_coefficients": [0.1, 1.0, 0.2, -0.3], "conflict_threshold": -0.02,
        "scalers": {"": {"gap_60": scaler, "spot_ret_60": scaler}}, "note": {"z": 1, "a": ["ü", None]},
    }
    return D.frozen(p | changes)


def without(p, key):
    return D.frozen({k: v for k, v in p.items() if k != key})


FLAT = {"low": -1.0, "high": 1.0, "mean": 0.0, "std": 0.0}
BROKEN = {
    "UNREADABLE": "{not json", "MISSING_KEYS": without(policy(), "scalers"), "BAD_VERSION": policy(policy_schema_version=2), "BAD_MODE": policy(mode="live"), "ACTING_KEY": policy(max_order_value=1),
    "SYNTHETIC": policy(synthetic=True), "BAD_COHORT": policy(cohort="horizon"), "BAD_FEATURE": policy(feature_name="funding_rate", controls=["spot_ret_60"]), "BAD_GROUP": policy(coin_or_group="DOGE"),
    "BAD_THRESHOLD": policy(conflict_threshold=0.0), "BAD_CONTROLS": policy(controls=["spot_rv_60"], scalers={"": {"gap_60": FLAT | {"std": 1.0}, "spot_rv_60": FLAT | {"std": 1.0}}}),
    "BAD_INTERACTION": policy(reliability_interaction=True, model_c_coefficients=[0.1, 1.0, 0.2, -0.3, 0.0]), "BAD_LENGTHS": policy(model_b_coefficients=[0.1, 1.0]),
    "NOT_FINITE": policy(model_b_coefficients=[0.1, None, 0.2]), "BAD_SCALER": policy(scalers={"": {"gap_60": FLAT, "spot_ret_60": FLAT | {"std": 1.0}}}), "EDITED": policy() | {"conflict_threshold": -0.5},
}


def test_each_rule_is_broken_by_its_document(spark):
    rows = [(code, x if isinstance(x, str) else json.dumps(x)) for code, x in BROKEN.items()] + [("good", json.dumps(policy())), ("list", "[1]"), ("none", None)]
    found = {r.name: r for r in D.judged(spark.createDataFrame(rows, "name string, document string")).collect()}
    for code in BROKEN:
        extra = {"BAD_FEATURE": ["BAD_FEATURE", "BAD_CONTROLS", "BAD_SCALER"]}.get(code, [code])
        assert found[code].problems == extra and not found[code].good, code
    assert found["good"].good and found["good"].policy.feature_name == "gap_60"
    assert found["list"].problems == ["UNREADABLE"] and found["none"].problems == ["UNREADABLE"]
    wide = policy(feature_name="premium", controls=["spot_ret_60", "spot_shock_300"], model_b_coefficients=[0.0] * 4, model_c_coefficients=[0.0] * 5, scalers={c: {x: FLAT | {"std": 1.0} for x in ("premium", "spot_ret_60", "spot_shock_300")} for c in ("BTC", "ETH")})
    held = policy(feature_name="spread", controls=["spot_shock_300"], reliability_interaction=True, model_c_coefficients=[0.0] * 5, scalers={"": {x: FLAT | {"std": 1.0} for x in ("spread", "spot_shock_300")}})
    more = spark.createDataFrame([(json.dumps(x),) for x in (wide, held)], "document string")
    assert [r.problems for r in D.judged(more).collect()] == [[], []] and D.registry_status(D.judged(more)) == "ok"
    assert D.registry_status(D.judged(spark.createDataFrame(rows, "name string, document string"))) == "error" and D.registry_status(D.judged(more.limit(0))) == "no_policies"


def test_exactly_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (3, "again")], "k int, y string")
    assert {(r.k, r.x, r.y) for r in D.exactly_one(left, right, ["k"]).collect()} == {(1, "a", "one"), (2, "b", "two")}
    for k in (3, 4):
        with pytest.raises(Exception, match="not one row for"):
            D.exactly_one(spark.createDataFrame([(k, "c")], "k int, x string"), right, ["k"]).collect()


def test_journal_binding(spark):
    rng, journal = random.Random(2), []
    for i in range(300):
        p = rng.choice("abc")
        journal.append((p, rng.randrange(60), None if rng.random() < 0.05 else rng.randrange(1_000), "other" if p == "b" and rng.random() < 0.1 else f"hash-{p}", -0.1 if p != "c" or rng.random() < 0.8 else rng.choice([None, -0.2])))
    want = {}
    for p in "abcd":
        first = {}
        for r in sorted((r for r in journal if r[0] == p), key=lambda r: (r[2] or 0, r[2] is not None, r[2] or 0, r[3], r[4] is not None, r[4] or 0)):
            first.setdefault(r[1], r)
        used = [r for r in first.values() if r[2] is not None and 100 < r[2] <= 900]
        want[p] = (len(used), sum(r[3] != f"hash-{p}" for r in used), sum(r[4] is None or abs(r[4] + 0.1) > 1e-12 for r in used))
    policies = [(p, f"hash-{p}", -0.1, 100, 900, want[p][0] + (p == "a")) for p in "abcd"]
    table = spark.createDataFrame(journal, "policy string, ticker int, us long, hash string, threshold double")
    about = spark.createDataFrame(policies, "policy string, hash string, threshold double, cutoff_us long, last_us long, reported long")
    got = {r.policy: r for r in D.journal_binding(table, about).collect()}
    assert {p: (r.used, r.bad_hash, r.bad_threshold) for p, r in got.items()} == want
    assert got["a"].problems == "ROWS" and "HASH" in got["b"].problems and "THRESHOLD" in got["c"].problems and got["d"].problems == "" and got["d"].digest == "0:0"
    again = {r.policy: r.digest for r in D.journal_binding(table.repartition(7, "us"), about).collect()}
    assert again == {p: r.digest for p, r in got.items()} and len(set(again.values())) == 4
