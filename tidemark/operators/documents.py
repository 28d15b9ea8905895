"""Policy documents as rows: rules over parsed documents, a registry split into good and bad, and what binds them to a journal."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark.functions.text import document_sha256
from tidemark.operators import catalog as K

POLICY_VERSION, MODE = 1, "shadow_only"
REQUIRED = ("policy_id", "policy_hash", "policy_schema_version", "mode", "synthetic", "cohort", "feature_name", "coin_or_group", "controls", "reliability_interaction", "model_b_coefficients", "model_c_coefficients", "conflict_threshold", "scalers")
#: Words that no key of a policy may hold: a policy judges calls and never acts (fixed values).
ACTING = ("order", "execute", "size", "stake", "bankroll", "leverage", "api_key", "secret")
_SCALER = "struct<low:double,high:double,mean:double,std:double>"
SCHEMA = (
    "policy_id string, policy_hash string, policy_schema_version int, mode string, synthetic boolean, cohort string, feature_name string, coin_or_group string, controls array<string>, "
    f"reliability_interaction boolean, model_b_coefficients array<double>, model_c_coefficients array<double>, conflict_threshold double, scalers map<string,map<string,{_SCALER}>>"
)


def _digest(text: Column) -> Column:
    """SHA-256 of a document in canonical form without its own hash; null for what is no document."""
    # keys of any depth must be sorted, which no built-in function does
    return F.udf(_own_digest, T.StringType(), useArrow=True)(text)


def _own_digest(text: str | None) -> str | None:
    try:
        document = json.loads(text)
    except (TypeError, ValueError):
        return None
    return document_sha256({k: v for k, v in document.items() if k != "policy_hash"}) if isinstance(document, dict) else None


def frozen(document: dict) -> dict:
    """The document with the hash of its content."""
    return document | {"policy_hash": document_sha256({k: v for k, v in document.items() if k != "policy_hash"})}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)


def policy_rules(p: Column, keys: Column, hashed: Column) -> dict[str, Column]:
    """What may be wrong with a parsed policy, by code; true where it is.  A document that lacks a key is not judged further."""
    first = F.create_map(*[F.lit(x) for f in K.CANDIDATES if f not in K.EXPLORATORY for x in (f, K.spot_controls(f)[0])])
    feature, controls = p["feature_name"], p["controls"]
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    known = F.coalesce(feature.isin(*K.DIRECTIONAL, *K.RELIABILITY), F.lit(False))
    second = (F.size(controls) == 2) & feature.isin(*K.BASIS) & (F.get(controls, F.lit(1)) == K.SECOND_CONTROL)
    mapped = (F.get(controls, F.lit(0)) == F.try_element_at(first, feature)) & ((F.size(controls) == 1) | second)
    reliable = F.coalesce(feature.isin(*K.RELIABILITY), F.lit(False))
    n_b = 2 + F.size(controls)
    lengths = (F.size(p["model_b_coefficients"]) == n_b) & (F.size(p["model_c_coefficients"]) == n_b + F.when(p["reliability_interaction"], 2).otherwise(1))
    finite = F.forall(p["model_b_coefficients"], _finite) & F.forall(p["model_c_coefficients"], _finite)
    sound = lambda s: F.coalesce(_finite(s["low"]) & _finite(s["high"]) & _finite(s["mean"]) & _finite(s["std"]) & (s["low"] <= s["high"]) & (s["std"] > C.ZERO_VARIANCE), F.lit(False))
    needed = F.concat(controls, F.array(feature))
    scalers = F.forall(F.map_values(p["scalers"]), lambda cols: (F.size(F.array_except(needed, F.map_keys(cols))) == 0) & F.forall(F.map_values(cols), sound))
    no = lambda test: ~F.coalesce(test, F.lit(False))
    rules = {
        "BAD_VERSION": no(p["policy_schema_version"] == POLICY_VERSION),
        "BAD_MODE": no(p["mode"] == MODE),
        "ACTING_KEY": F.exists(keys, lambda k: F.lower(k).rlike("|".join(ACTING))),
        "SYNTHETIC": no(~p["synthetic"]),
        "BAD_COHORT": no(p["cohort"] == "first_signal"),
        "BAD_FEATURE": ~known,
        "BAD_GROUP": no(p["coin_or_group"].isin("ALL", *C.COINS)),
        "BAD_THRESHOLD": no(_finite(p["conflict_threshold"]) & (p["conflict_threshold"] < 0)),
        "BAD_CONTROLS": no(mapped),
        "BAD_INTERACTION": no(p["reliability_interaction"] == reliable),
        "BAD_LENGTHS": no(lengths),
        "NOT_FINITE": no(finite),
        "BAD_SCALER": no(scalers & (F.size(p["scalers"]) > 0)),
        "EDITED": no(hashed == p["policy_hash"]),
    }
    absent = F.coalesce(F.size(missing) > 0, F.lit(True))
    return {"UNREADABLE": keys.isNull(), "MISSING_KEYS": keys.isNotNull() & absent} | {k: keys.isNotNull() & ~absent & v for k, v in rules.items()}


def judged(documents: DataFrame, text: str = "document") -> DataFrame:
    """Adds ``policy`` (parsed), ``problems`` (codes in the order of the rules) and ``good`` to documents, one a row."""
    rows = documents.withColumns({"policy": F.from_json(text, SCHEMA), "__keys": F.json_object_keys(F.col(text)), "__hash": _digest(F.col(text))})
    rules = policy_rules(F.col("policy"), F.col("__keys"), F.col("__hash"))
    found = rows.withColumn("problems", F.array_compact(F.array(*[F.when(test, code) for code, test in rules.items()]))).drop("__keys", "__hash")
    return found.withColumn("good", F.size("problems") == 0)


def registry_status(judgements: DataFrame) -> str:
    """error if any document is bad, ok if all are good, no_policies if there are none."""
    good, bad = judgements.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    return "error" if bad else "ok" if good else "no_policies"


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of the one row of ``right`` that has its keys; fails where there is none or more than one."""
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*values)).alias("__r"))
    told = F.concat(F.lit("not one row for "), F.to_json(F.struct(*keys)), F.lit(": "), F.coalesce("__n", F.lit(0)).cast("string"))
    checked = F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(told))
    return left.join(one, keys, "left").withColumn("__r", checked).select(*left.columns, "__r.*")


def row_set_digest(columns: list[str]) -> Column:
    """An aggregate that names a set of rows whatever their order: their number and the sum of their digests."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string"))


def journal_binding(journal: DataFrame, policies: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Per policy whether the journal rows that its report was made of are the ones it says.

    ``policies`` are (policy, hash, threshold, cutoff_us, last_us, reported); ``journal`` is (policy, ticker, us, hash,
    threshold).  The report's choice is made again: of each ticker the earliest row (one without a time counts as the
    first), if it lies after the cutoff and not after the report's last time.  Gives used, bad_hash, bad_threshold,
    digest of the chosen rows, problems.
    """
    early = F.struct(F.coalesce("us", F.lit(0)).alias("at"), "us", "hash", "threshold")
    first = journal.groupBy("policy", "ticker").agg(F.min(early).alias("r")).select("policy", "ticker", "r.us", F.col("r.hash").alias("row_hash"), F.col("r.threshold").alias("row_threshold"))
    chosen = first.join(policies, "policy").where((F.col("us") > F.col("cutoff_us")) & (F.col("us") <= F.col("last_us")))
    differs = F.coalesce(F.abs(F.col("row_threshold") - F.col("threshold")) > tolerance, F.lit(True))
    found = chosen.groupBy("policy").agg(
        F.count("*").alias("used"), F.count_if(F.coalesce(F.col("row_hash") != F.col("hash"), F.lit(True))).alias("bad_hash"), F.count_if(differs).alias("bad_threshold"), row_set_digest(["ticker", "us", "row_hash"]).alias("digest")
    )
    out = policies.join(found, "policy", "left").fillna(0, ["used", "bad_hash", "bad_threshold"]).withColumn("digest", F.coalesce("digest", F.lit("0:0")))
    wrong = F.concat_ws(";", F.when(F.col("used") != F.col("reported"), "ROWS"), F.when(F.col("bad_hash") > 0, "HASH"), F.when(F.col("bad_threshold") > 0, "THRESHOLD"))
    return out.select("policy", "used", "bad_hash", "bad_threshold", "digest", wrong.alias("problems"))
