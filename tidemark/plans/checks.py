"""Queries that check feature rows: causal rules, blank values, controls, flags, extremes, and how a row is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import market as M
from tidemark.operators import catalog as K
from tidemark.operators import features as feat
from tidemark.operators import integrity as I
from tidemark.operators import scans
from tidemark.plans.quality import CHECKED
from tidemark.plans.sql_features import S, features as with_features
from tidemark.plans.telemetry import features, inputs, steady, steady_sql
from tidemark.sources import views as V
from tidemark.storage import written

BLANKS = [*(f"{side}_z_{h}" for side in ("perp", "spot", "gap") for h in C.HORIZONS), "premium_stress", "spread_ratio"]


def causal_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready rows by the causal rule that they break; some rows here are moved, so that every rule is broken."""
    i, us, s = F.col("event_id"), F.col("us"), V.SECOND
    snapshot = F.when(i % 11 == 0, us + 5 * s).otherwise(F.col("snapshot_us"))
    end = F.when(i % 13 == 0, us + 2 * s).otherwise(us)
    lag = F.when(i % 7 == 0, F.lit(-3 * s)).when(i % 5 == 0, F.col("lag_us") + s).when(i % 17 != 0, F.col("lag_us"))
    reason = I.causal_violation(F.col("ready"), us, snapshot, end, lag)
    rows = features(spark, sf_dir).withColumn("reason", F.when(~F.col("ready"), "NOT_READY").otherwise(F.coalesce(reason, F.lit("SOUND"))))
    return rows.groupBy("coin", "reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def missing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why normalised features are blank, by feature."""
    each = F.filter(F.array(*[F.struct(F.lit(f).alias("feature"), K.blank_reason(f).alias("reason")) for f in BLANKS]), lambda x: x["reason"].isNotNull())
    rows = features(spark, sf_dir).select("coin", F.explode(each).alias("e")).select("coin", "e.*")
    return rows.groupBy("feature", "reason").agg(F.count("*").alias("n"), F.count_distinct("coin").alias("coins"))


def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its family and spot controls; the second control of basis features depends on its coverage."""
    shared = (*K.BASIS, *K.EXPLORATORY)
    usable = {f: F.col(f).isNotNull() & F.col("spot_ret_60").isNotNull() for f in shared}
    second = F.col(K.SECOND_CONTROL).isNotNull()
    counts = [x for f, test in usable.items() for x in (F.count_if(test).alias(f"n_{f}"), F.count_if(test & second).alias(f"m_{f}"))]
    one = features(spark, sf_dir).agg(*counts)

    def entry(name: str) -> F.Column:
        covered = F.col(f"m_{name}") / F.nullif(F.col(f"n_{name}"), F.lit(0)) if name in usable else F.lit(None).cast("double")
        extra = F.when(covered >= K.SECOND_COVERAGE, K.SECOND_CONTROL) if name in usable else F.lit(None).cast("string")
        return F.struct(F.lit(K.check_predictor(name)).alias("feature"), F.lit(K.family(name)).alias("family"), F.lit(K.spot_controls(name)[0]).alias("control_1"), extra.alias("control_2"), F.round(covered, 5).alias("coverage"))

    return one.select(F.explode(F.array(*map(entry, K.CANDIDATES))).alias("e")).select("e.*")


def flag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags from the most common on."""
    flags = features(spark, sf_dir).select(F.explode(F.filter(F.split("flags", ";"), lambda x: x != "")).alias("flag"))
    counts = flags.groupBy("flag").agg(F.count("*").alias("n"))
    # one row for each flag code
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "flag")))


def feature_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).unpivot([], [F.col(c).cast("double").alias(c) for c in CHECKED], "feature", "x").where("x IS NOT NULL")
    rows = written(rows)
    found = rows.groupBy("feature").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"))
    found = found.join(scans.percentiles(rows, ["feature"], ["x"], (0.01, 0.5, 0.99)).select("feature", "q"), "feature")
    values = {"min": F.col("min"), "p01": F.col("q")[0], "median": F.col("q")[1], "p99": F.col("q")[2], "max": F.col("max")}
    return found.withColumns(values).select("feature", "n", *[steady(v).alias(v) for v in values])


def display_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each row: a direction and how reliable it is."""
    rows = features(spark, sf_dir)
    labels = M.level_labels(F.col("vol_regime"), F.col("gap_z_60"), F.col("premium_stress"), F.col("spread_ratio"))
    lag = F.round(F.col("lag_us") / (C.TIME_SCALE * V.SECOND), 1)
    return rows.select("event_id", "coin", M.direction(F.col("perp_z_60")).alias("direction"), "vol_regime", *[x.alias(f"{n}_label") for n, x in labels.items()], "stability", F.nullif(F.col("reasons"), F.lit("")).alias("reasons"), "source_status", "ready", lag.alias("lag_s"))


def latest_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simpler row: returns up to the newest snapshot, if it still counts as current."""
    rows = feat.latest_rows(*inputs(spark, sf_dir))
    shown = ["premium", *(f"{side}_ret_{h}" for h in C.HORIZONS for side in ("perp", "spot")), *(f"lead_{h}" for h in C.HORIZONS)]
    return rows.select("event_id", "coin", "status", *[steady(c).alias(c) for c in shown])


def queries() -> dict:
    own = (causal_invariants, missing_reasons, feature_catalog, flag_ranking, feature_extremes, display_view, latest_returns)
    return {f.__name__: f for f in own}


def _blank_sql(name: str) -> str:
    """(feature, reason) rows of one feature."""
    side, h = name.split("_", 1)[0], name.rsplit("_", 1)[-1]
    floor, warm = "'RV300_BELOW_NUMERICAL_FLOOR'", "WHEN {s}_rv_300 IS NULL THEN '{u}_RV300_WARMUP_OR_GAP'"
    unusable = "WHEN NOT perp_ok THEN 'PERP_SNAPSHOT_NOT_USABLE'"
    own = lambda s: warm.format(s=s, u=s.upper())
    cases = {
        "perp": f"{unusable} WHEN perp_ret_{h} IS NULL THEN 'PERP_{h}S_RETURN_WARMUP_OR_GAP' {own('perp')} ELSE {floor}",
        "spot": f"WHEN spot_ret_{h} IS NULL THEN 'SPOT_{h}S_RETURN_WARMUP_OR_GAP' {own('spot')} ELSE {floor}",
        "gap": f"{unusable} WHEN gap_{h} IS NULL THEN 'GAP_{h}S_UNAVAILABLE' {own('perp')} {own('spot')} ELSE {floor}",
        "premium": f"{unusable} ELSE 'PREMIUM_Z_5M_WARMUP_OR_ZERO_VARIANCE'",
        "spread": f"{unusable} WHEN spread IS NULL THEN 'NO_VALID_CURRENT_SPREAD' WHEN spread_median IS NULL THEN 'SPREAD_BASELINE_INSUFFICIENT' ELSE 'SPREAD_BASELINE_ZERO'",
    }
    return f"SELECT coin, '{name}' AS feature, CASE {cases[side]} END AS reason FROM features WHERE {name} IS NULL"


def _entry_sql(name: str) -> str:
    kind = next(k for k, names in K.FAMILIES.items() if name in names)
    control = K.spot_controls(name)[0]
    covered = "count(spot_shock_300) / nullif(count(*), 0)" if name in (*K.BASIS, *K.EXPLORATORY) else "CASE WHEN count(*) < 0 THEN 0.0::DOUBLE END"
    return f"SELECT '{name}' AS feature, '{kind}' AS family, '{control}' AS control_1, CASE WHEN {covered} >= 0.8 THEN 'spot_shock_300' END AS control_2, round({covered}, 5) AS coverage FROM features WHERE {name} IS NOT NULL AND spot_ret_60 IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    level = lambda v, n: f"CASE {v} WHEN 0 THEN '{n[0]}' WHEN 1 THEN '{n[1]}' WHEN 2 THEN '{n[2]}' ELSE 'UNKNOWN' END"
    stress = lambda x, a, b: f"CASE WHEN abs({x}) >= {b} THEN 2 WHEN abs({x}) >= {a} THEN 1 WHEN {x} IS NOT NULL THEN 0 END"
    quantile = lambda q: f"floor(quantile_cont(x, {q}) * 100 + 0.1234::DOUBLE) / 100"
    shown = ["premium", *(f"{side}_ret_{h}" for h in C.HORIZONS for side in ("perp", "spot")), *(f"lead_{h}" for h in C.HORIZONS)]
    perps = ", ".join(f"CASE WHEN status = 'fresh' THEN f.perp_ret_{h} END AS perp_ret_{h}" for h in C.HORIZONS)
    return {
        "causal_invariants": with_features("""SELECT coin, reason, count(*) AS n, min(event_id) AS first_id FROM (SELECT coin, event_id, CASE WHEN NOT ready THEN 'NOT_READY' WHEN lag IS NULL THEN 'MISSING_TIMESTAMP' WHEN snap > us + 1000 THEN 'SNAPSHOT_AFTER_SPOT'
                WHEN fin > us + 1000 THEN 'FEATURE_END_AFTER_SPOT' WHEN lag < -1000 THEN 'NEGATIVE_LAG' WHEN abs(us - snap - lag) > 2000 THEN 'LAG_INCONSISTENT' ELSE 'SOUND' END AS reason
            FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN us + 5000000 ELSE snapshot_us END AS snap, CASE WHEN event_id % 13 = 0 THEN us + 2000000 ELSE us END AS fin,
                CASE WHEN event_id % 7 = 0 THEN -3000000 WHEN event_id % 5 = 0 THEN lag_us + 1000000 WHEN event_id % 17 <> 0 THEN lag_us END AS lag FROM features)) GROUP BY ALL"""),
        "missing_reasons": with_features("SELECT feature, reason, count(*) AS n, count(DISTINCT coin) AS coins FROM (" + " UNION ALL ".join(map(_blank_sql, BLANKS)) + ") GROUP BY ALL"),
        "feature_catalog": with_features(" UNION ALL ".join(map(_entry_sql, K.CANDIDATES))),
        "flag_ranking": with_features("SELECT *, row_number() OVER (ORDER BY n DESC, flag)::INT AS place FROM (SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM features) WHERE flag <> '' GROUP BY flag)"),
        "feature_extremes": with_features(f"SELECT feature, count(*) AS n, {steady_sql('min(x)')} AS min, {quantile(0.01)} AS p01, {quantile(0.5)} AS median, {quantile(0.99)} AS p99, {steady_sql('max(x)')} AS max FROM ("
                                          + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM features WHERE {c} IS NOT NULL" for c in CHECKED) + ") GROUP BY feature"),
        "display_view": with_features(f"""SELECT event_id, coin, CASE WHEN perp_z_60 >= 1 THEN 'UP' WHEN perp_z_60 <= -1 THEN 'DOWN' WHEN perp_z_60 IS NOT NULL THEN 'FLAT' END AS direction, vol_regime,
            {level(stress('gap_z_60', 1, 2), ('AGREE', 'DIVERGING', 'DISAGREE'))} AS agreement_label, {level(stress('premium_stress', 2.5, 4), ('NORMAL', 'ELEVATED', 'EXTREME'))} AS premium_label,
            {level(stress('spread_ratio', 2, 4), ('NORMAL', 'WIDENING', 'BLOWOUT'))} AS spread_label, stability, nullif(reasons, '') AS reasons, source_status, ready, round(lag_us / {S}.0::DOUBLE, 1) AS lag_s FROM features"""),
        "latest_returns": with_features(f"""SELECT event_id, coin, status, {", ".join(f"{steady_sql(c)} AS {c}" for c in shown)} FROM (SELECT *, {", ".join(f"round(perp_ret_{h} - spot_ret_{h}, 4) AS lead_{h}" for h in C.HORIZONS)} FROM (
            SELECT a.event_id, a.coin, status, round(CASE WHEN status = 'fresh' THEN any_premium END, 4) AS premium, {perps}, {", ".join(f"spot_ret_{h}" for h in C.HORIZONS)}
            FROM (SELECT *, CASE WHEN snapshot_id IS NULL THEN 'missing' WHEN source_status <> 'fresh' THEN source_status WHEN index_age_s * {S} + lag_us > {15 * S} THEN 'stale' ELSE 'fresh' END AS status FROM paired) a
            LEFT JOIN perp_features f ON f.event_id = snapshot_id))"""),
    }
