"""Data-quality queries over the causal features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.groups import each_and_all, overall_and_by, share, with_percentiles
from tidemark.plans.sql_features import features as with_features
from tidemark.plans.telemetry import features, inputs
from tidemark.storage import written

CHECKED = ["premium", "premium_z_5m", "premium_z_15m", "perp_rv_60", "perp_rv_300", "perp_rv_900", "spot_rv_300", "spread_ratio", "gap_z_60", "perp_z_60", "spot_z_60"]
#: Values beyond these are pathological (fixed values).
BOUNDS = {"premium_z_5m": (-50, 50), "premium_z_15m": (-50, 50), "gap_z_60": (-50, 50), "perp_z_60": (-50, 50), "spot_z_60": (-50, 50), "spread_ratio": (0, 50), "spread_median": (0, 1000)}


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumn("lag_ms", F.col("lag_us") / 1000)
    rows = written(rows.select("coin", "session", "ready", "pair_ok", "perp_ok", "flags", "lag_ms", "latency_ms"))
    n = F.count("*")
    found = overall_and_by(
        rows,
        "coin",
        [
            n.alias("n_rows"), F.count_distinct("session").alias("sessions"), F.count_if("ready").alias("ready"), share(F.count_if("ready"), n).alias("ready_pct"),
            share(F.count_if("pair_ok"), n).alias("pair_pct"), share(F.count_if("perp_ok"), n).alias("perp_pct"), share(F.count_if(F.col("flags") == ""), n).alias("clean_pct"),
            F.max("lag_ms").alias("lag_max"), F.max("latency_ms").alias("latency_max"),
        ],
    )
    found = with_percentiles(found, each_and_all(rows, "coin"), ["grp"], {"lag_p50": ("lag_ms", 0.5), "lag_p95": ("lag_ms", 0.95)})
    return found.withColumns({c: F.round(c, 3) for c in ("lag_p50", "lag_p95")})


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots, _, _ = inputs(spark, sf_dir)
    w = Window.partitionBy("session", "coin").orderBy("us")
    steps = spots.select("session", "coin", "us").distinct().withColumn("step", (F.lead("us").over(w) - F.col("us")) / 1e6)
    longest = F.max_by("us", F.struct("step", (-F.col("us")).alias("t")))
    steps = written(steps.where("step IS NOT NULL"))
    found = overall_and_by(steps, "coin", [F.count("*").alias("intervals"), F.round(F.max("step"), 4).alias("step_max"), longest.alias("longest_from_us")])
    wanted = {f"step_p{round(q * 100)}": ("step", q) for q in (0.5, 0.9, 0.95, 0.99)}
    return with_percentiles(found, each_and_all(steps, "coin"), ["grp"], wanted).withColumns({c: F.round(c, 4) for c in wanted})


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    one = rows.agg(F.count("*").alias("n"), F.count_if("ready").alias("r"), *[F.count(c).alias(f"a_{c}") for c in CHECKED], *[F.count(F.when(F.col("ready"), F.col(c))).alias(f"r_{c}") for c in CHECKED])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), share(F.col(f"a_{c}"), F.col("n")).alias("all_pct"), share(F.col(f"r_{c}"), F.col("r")).alias("ready_pct")) for c in CHECKED]))
    return one.select(each.alias("e")).select("e.*")


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("coin", F.explode(F.filter(F.split("flags", ";"), lambda x: x != "")).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("coin").alias("coins"))


def regime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    found = rows.groupingSets([["vol_regime"], ["coin", "vol_regime"]], "coin", "vol_regime").agg(F.count("*").alias("n"), F.count_if("ready").alias("ready"))
    found = found.withColumn("grp", F.coalesce("coin", F.lit("ALL"))).drop("coin")
    every = spark.createDataFrame([(g, r) for g in ("ALL", *C.COINS) for r in C.REGIMES], "grp string, vol_regime string")
    return every.join(found, ["grp", "vol_regime"], "left").fillna(0)


def stability_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_and_by(features(spark, sf_dir), "coin", [F.count_if(F.col("stability") == s).alias(s.lower()) for s in ("STABLE", "CAUTION", "UNSTABLE", "UNKNOWN")])


def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of defects of the raw series: order by arrival (event id) against order by time."""
    spots, snapshots, _ = inputs(spark, sf_dir)
    arrival = Window.partitionBy("coin", "session").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    late = spots.withColumn("late", F.coalesce(F.col("us") < F.max("us").over(arrival), F.lit(False)))
    same = late.groupBy("coin", "us").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))
    s = same.groupBy("coin").agg(F.sum("n").alias("spot_rows"), F.sum(F.col("n") - 1).alias("duplicate_times"), F.sum("late").alias("out_of_order"))
    p = snapshots.groupBy("coin").agg(
        F.count("*").alias("perp_rows"), F.count_if(F.col("bid") > F.col("ask")).alias("crossed"), F.count_if(F.col("index_price").isNull()).alias("missing_index"),
        F.count_if(F.col("source_status") != "fresh").alias("source_errors"), F.count_if(F.coalesce(F.col("bid") <= 0, F.lit(True))).alias("bad_price"),
    )
    return s.join(p, "coin")


def pathological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bounded feature the values beyond the bounds, with the first five rows."""
    rows = features(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for c, (a, b) in BOUNDS.items()]))
    flat = rows.select("event_id", each.alias("e")).select("event_id", "e.*").where("x IS NOT NULL")
    beyond = flat.withColumn("bad", (F.col("x") < F.col("low")) | (F.col("x") > F.col("high")))
    counts = beyond.groupBy("feature").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    # the first five of each slice, then the first five of those
    slices = beyond.where("bad").withColumn("slice", F.pmod(F.hash("event_id"), F.lit(64)))
    near = slices.withColumn("place", F.row_number().over(Window.partitionBy("feature", "slice").orderBy("event_id"))).where("place <= 5")
    five = near.groupBy("feature").agg(F.array_join(F.slice(F.array_sort(F.collect_list("event_id")), 1, 5), ",").alias("examples"))
    return counts.join(five, "feature", "left").select("feature", "n", "n_bad", F.coalesce("examples", F.lit("")).alias("examples"))


def blank_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the 5-minute premium z is blank, by the first reason that applies."""
    c = F.col
    reason = (
        F.when(c("snapshot_id").isNull(), "no_snapshot").when(~c("pair_ok"), "pair_too_old").when(~c("perp_ok"), "perp_not_fresh")
        .when(~c("has_mid"), "no_mid").when(~c("has_index"), "no_index").when(c("premium_z_5m_n") < 20, "too_few_points").otherwise("short_span_or_flat")
    )
    return features(spark, sf_dir).where("premium_z_5m IS NULL").groupBy("coin", reason.alias("reason")).agg(F.count("*").alias("n"))


def volatility_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(features(spark, sf_dir).select("coin", "perp_shock_300", "spot_shock_300", "vol_regime"))
    found = overall_and_by(rows, "coin", [
        F.count("perp_shock_300").alias("perp_n"), F.count("spot_shock_300").alias("spot_n"), F.count_if(F.col("vol_regime") == "EXTREME").alias("extreme"),
    ])
    wanted = {f"{s}_shock_p{round(q * 100):02d}": (f"{s}_shock_300", q) for s in ("perp", "spot") for q in (0.01, 0.5, 0.99)}
    return with_percentiles(found, each_and_all(rows, "coin"), ["grp"], wanted).withColumns({c: F.round(c, 2) for c in wanted})


def queries() -> dict:
    return {f.__name__: f for f in (quality_profile, cadence, coverage, flag_counts, regime_distribution, stability_distribution, structural_checks, pathological, blank_reasons, volatility_section)}


def _pct(a: str, b: str = "count(*)") -> str:
    return f"round(100 * {a} / nullif({b}, 0), 2)"


def oracle_sql() -> dict[str, str]:
    sets = "GROUP BY GROUPING SETS ((), (coin))"
    grp = "CASE WHEN grouping(coin) = 0 THEN coin ELSE 'ALL' END AS grp"
    bounded = " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, {c} AS x, {a} AS low, {b} AS high FROM features WHERE {c} IS NOT NULL" for c, (a, b) in BOUNDS.items())
    return {
        "quality_profile": with_features(f"""SELECT {grp}, count(*) AS n_rows, count(DISTINCT session) AS sessions, count(*) FILTER (ready) AS ready, {_pct('count(*) FILTER (ready)')} AS ready_pct,
            {_pct('count(*) FILTER (pair_ok)')} AS pair_pct, {_pct('count(*) FILTER (perp_ok)')} AS perp_pct, {_pct("count(*) FILTER (flags = '')")} AS clean_pct,
            round(quantile_cont(lag_us / 1000, 0.5), 3) AS lag_p50, round(quantile_cont(lag_us / 1000, 0.95), 3) AS lag_p95, max(lag_us / 1000) AS lag_max, max(latency_ms) AS latency_max FROM features {sets}"""),
        "cadence": with_features(f"""SELECT {grp}, count(*) AS intervals, {", ".join(f"round(quantile_cont(step, {q}), 4) AS step_p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))}, round(max(step), 4) AS step_max,
            arg_max(us, (step, -us)) AS longest_from_us FROM (SELECT coin, us, (lead(us) OVER (PARTITION BY session, coin ORDER BY us) - us) / 1e6::DOUBLE AS step FROM (SELECT DISTINCT session, coin, us FROM spots)) WHERE step IS NOT NULL {sets}"""),
        "coverage": with_features(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_pct(f'count({c})')} AS all_pct, {_pct(f'count({c}) FILTER (ready)', 'count(*) FILTER (ready)')} AS ready_pct FROM features" for c in CHECKED)),
        "flag_counts": with_features("SELECT flag, count(*) AS n, count(DISTINCT coin) AS coins FROM (SELECT coin, unnest(string_split(flags, ';')) AS flag FROM features) WHERE flag <> '' GROUP BY flag"),
        "regime_distribution": with_features("""SELECT g.grp, r.vol_regime, count(f.event_id) AS n, count(f.event_id) FILTER (f.ready) AS ready
            FROM (SELECT unnest(['ALL', 'BTC', 'ETH', 'SOL', 'XRP']) AS grp) g CROSS JOIN (SELECT unnest(['LOW', 'NORMAL', 'HIGH', 'EXTREME', 'UNKNOWN']) AS vol_regime) r
            LEFT JOIN features f ON f.vol_regime = r.vol_regime AND g.grp IN ('ALL', f.coin) GROUP BY ALL"""),
        "stability_distribution": with_features(f"SELECT {grp}, {', '.join(f'''count(*) FILTER (stability = '{s}') AS {s.lower()}''' for s in ('STABLE', 'CAUTION', 'UNSTABLE', 'UNKNOWN'))} FROM features {sets}"),
        "structural_checks": with_features("""SELECT coin, spot_rows, duplicate_times, out_of_order, perp_rows, crossed, missing_index, source_errors, bad_price FROM
            (SELECT coin, count(*) AS spot_rows, count(*) - count(DISTINCT us) AS duplicate_times, count(*) FILTER (late) AS out_of_order
             FROM (SELECT *, us < max(us) OVER (PARTITION BY coin, session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM spots) GROUP BY coin)
            JOIN (SELECT coin, count(*) AS perp_rows, count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (index_price IS NULL) AS missing_index, count(*) FILTER (source_status <> 'fresh') AS source_errors,
                  count(*) FILTER (bid <= 0 OR bid IS NULL) AS bad_price FROM snapshots GROUP BY coin) USING (coin)"""),
        "pathological": with_features(f"""SELECT feature, count(*) AS n, count(*) FILTER (x < low OR x > high) AS n_bad,
            array_to_string(coalesce((list(event_id ORDER BY event_id) FILTER (x < low OR x > high))[1:5], []), ',') AS examples FROM ({bounded}) GROUP BY feature"""),
        "blank_reasons": with_features("""SELECT coin, CASE WHEN snapshot_id IS NULL THEN 'no_snapshot' WHEN NOT pair_ok THEN 'pair_too_old' WHEN NOT perp_ok THEN 'perp_not_fresh' WHEN NOT has_mid THEN 'no_mid'
            WHEN NOT has_index THEN 'no_index' WHEN premium_z_5m_n < 20 THEN 'too_few_points' ELSE 'short_span_or_flat' END AS reason, count(*) AS n FROM features WHERE premium_z_5m IS NULL GROUP BY ALL"""),
        "volatility_section": with_features(f"""SELECT {grp}, {", ".join(f"round(quantile_cont({s}_shock_300, {q}), 2) AS {s}_shock_p{round(q * 100):02d}" for s in ("perp", "spot") for q in (0.01, 0.5, 0.99))},
            count(perp_shock_300) AS perp_n, count(spot_shock_300) AS spot_n, count(*) FILTER (vol_regime = 'EXTREME') AS extreme FROM features {sets}"""),
    }
