"""Queries over streams, files and nested records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import history as H
from tidemark.plans import sql_features as S
from tidemark.plans import telemetry
from tidemark.sources import formats
from tidemark.sources import views as V
from tidemark.storage import reserved, shared_folder, written
from tidemark.streaming import cycles, store


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perp ticks as a stream through the bounded history of each coin."""
    schema = V.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("value > 0 AND event_type NOT IN ('view', 'click')")
    ticks = e.select(V.coin_of(F.col("user_id")).alias("coin"), "event_id", V.micros(F.col("ts")).alias("us"))
    base = reserved(spark, "store")
    store.accepted(ticks, base)
    return cycles.read(spark, base, "rows").drop("batch")


#: The stand-in for a contract's size: it changes every 20 days, and some records lack it.
CONTRACT_DAYS = 20
CUTS = 3


def _contract(us: F.Column, event_id: F.Column) -> F.Column:
    return F.when(event_id % 17 != 0, F.floor(us / (CONTRACT_DAYS * 86400 * V.SECOND)).cast("long"))


def _split(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spot rows with the cycles lost before them, snapshots with their contract) of ticks."""
    spots = V.spots(ticks).withColumn("drops", F.when(F.col("event_id") % 97 == 0, 2).otherwise(0).cast("long"))
    return spots, V.snapshots(ticks, C.TIME_SCALE).withColumn("contract", _contract(F.col("us"), F.col("event_id")))


def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snapshots the history takes in order of arrival, their generation, the last re-scale and the history's length."""
    _, snapshots = _split(V.ticks(spark, sf_dir))
    rows = written(H.admitted(snapshots, ["event_id"]))
    lengths = H.held(rows.where("taken"), C.TIME_SCALE).select("event_id", "held")
    return rows.join(lengths, "event_id", "left").select("event_id", "coin", "us", "taken", "known", "generation", "changed_us", "held")


def cycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal rows of a stream of ticks that comes in three parts, one cycle each, with re-scales and lost cycles."""
    base = reserved(spark, "cycles")
    ticks = V.ticks(spark, sf_dir)
    low, high = ticks.agg(F.min("us"), F.max("us")).first()
    part = F.floor((F.col("us") - (low or 0)) * CUTS / ((high or 0) - (low or 0) + 1))
    for k in range(CUTS):
        ticks.where(part == k).coalesce(1).write.mode("append").parquet(f"{base}/feed")
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    cycles.run(stream, f"{base}/out", C.TIME_SCALE, _split)
    rows = cycles.read(spark, f"{base}/out", "causal")
    shown = ("snapshot_id", "lag_us", "premium", "perp_ret_60", "premium_z_5m", "premium_z_15m_n", "perp_rv_300", "spread_ratio", "spot_rv_300", "gap_60", "vol_regime", "ready", "flags")
    return telemetry._shown(rows, *shown)


def telemetry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot rows written as telemetry files and read again, with header and version checks."""
    spots = V.spots(V.ticks(spark, sf_dir)).select(F.lit(3).alias("schema_version"), "event_id", "coin", "us", "spot", "binary_ok", F.when(F.col("latency_ms") >= 100, F.array(F.lit("SLOW"), "coin")).alias("notes"))
    path = f"{shared_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    formats.write_csv(spots, path)
    back = formats.read_csv(spark, path, spots.schema, {"schema_version": "3"})
    return back.select("event_id", "coin", "us", "spot", "binary_ok", F.array_join("notes", ";").alias("notes"))


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as nested provider records, parsed."""
    snapshots = V.snapshots(V.ticks(spark, sf_dir), 1)
    i = F.col("event_id")
    side = lambda c, missing: F.when(i % missing != 0, F.struct(F.col(c).cast("string").alias("price"), (F.col("us") / 1000).cast("long").alias("ts_ms")))
    record = F.to_json(F.struct(F.when(i % 61 != 0, F.col("coin")).alias("ticker"), F.when(i % 59 != 0, "active").otherwise("halted").alias("status"), side("bid", 31).alias("bid"), side("ask", 37).alias("ask"), side("mark", 7).alias("mark"), side("index_price", 43).alias("index")))
    parsed = formats.parse_records(snapshots.select("event_id", record.alias("record")), "record")
    return parsed.select("event_id", "ticker", F.round("mid", 6).alias("mid"), "problems", "source_status")


def queries() -> dict:
    return {f.__name__: f for f in (stream_store, snapshot_store, cycle_rows, telemetry_csv, snapshot_records)}


def _admitted_sql(order: str) -> str:
    """Snapshots admitted to the history, from raw_snapshots with cut."""
    before = f"(PARTITION BY coin ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""raw AS (SELECT *, CASE WHEN event_id % 17 <> 0 THEN us // {CONTRACT_DAYS * 86400 * V.SECOND} END AS contract FROM raw_snapshots),
        tried AS (SELECT *, coalesce(us > max(us) OVER {before}, true) AS taken FROM raw),
        told AS (SELECT *, last_value(CASE WHEN taken THEN contract END IGNORE NULLS) OVER {before} AS was FROM tried),
        changes AS (SELECT *, coalesce(taken AND contract <> was, false) AS changed, CASE WHEN taken THEN coalesce(contract, was) ELSE was END AS known FROM told),
        admitted AS (SELECT *, sum(changed::INT) OVER o::BIGINT AS generation, max(CASE WHEN changed THEN us END) OVER o AS changed_us FROM changes WINDOW o AS (PARTITION BY coin ORDER BY {order}))"""


def _cycles_sql() -> str:
    """The SQL of causal rows over admitted snapshots, generation by generation."""
    raw = S.SQL["snapshots"].replace("snapshots AS (", "raw_snapshots AS (", 1)
    cut = f"cuts AS (SELECT min(us) AS low, max(us) AS high FROM ticks), placed AS (SELECT r.*, ((us - low) * {CUTS}) // (high - low + 1) AS cut FROM raw_snapshots r, cuts)"
    snapshots = _admitted_sql("cut, event_id").replace("FROM raw_snapshots", "FROM placed") + ", snapshots AS (SELECT * FROM admitted WHERE taken)"
    perp = S.PERP.replace("PARTITION BY coin", "PARTITION BY coin, generation")
    pair = S.PAIR.replace("p.event_id AS snapshot_id", "p.changed_us, p.event_id AS snapshot_id")
    rescale = f"CASE WHEN us - changed_us <= {C.RESCALE_FLAG * S.S} THEN 'CONTRACT_SCALE_CHANGED' END"
    causal = S.CAUSAL.replace("THEN 'MISSING_INDEX' END,", f"THEN 'MISSING_INDEX' END, {rescale},").replace("THEN 'VOL_NORM_DENOMINATOR_TOO_SMALL' END)", "THEN 'VOL_NORM_DENOMINATOR_TOO_SMALL' END, CASE WHEN event_id % 97 = 0 THEN 'QUEUE_DROPS_SINCE_PREV' END)")
    return "WITH " + ", ".join([S.SQL["ticks"], raw, cut, snapshots, S.SQL["spots"], perp, S.SPOT, pair, causal])


def oracle_sql() -> dict[str, str]:
    shown = ("snapshot_id", "lag_us", "premium", "perp_ret_60", "premium_z_5m", "premium_z_15m_n", "perp_rv_300", "spread_ratio", "spot_rv_300", "gap_60", "vol_regime", "ready", "flags")
    own = telemetry._shown_sql(*shown)
    ticks = "WITH " + V.SQL["ticks"] + ", "
    return {
        "stream_store": ticks.rstrip(", ") + """ SELECT coin, event_id, us, taken, least(600, sum(taken::INT) OVER (PARTITION BY coin ORDER BY event_id))::BIGINT AS held
            FROM (SELECT *, us > coalesce(max(us) OVER (PARTITION BY coin ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS taken FROM ticks WHERE kind = 'perp')""",
        "snapshot_store": ticks + V.SQL["snapshots"].replace("snapshots AS (", "raw_snapshots AS (", 1) + ", " + _admitted_sql("event_id") + f""",
            lengths AS (SELECT event_id, least(600, count(*) OVER (PARTITION BY coin, generation ORDER BY us RANGE BETWEEN {C.HISTORY_AGE * S.S} PRECEDING AND CURRENT ROW)) AS held FROM admitted WHERE taken)
            SELECT event_id, coin, us, taken, known, generation, changed_us, held FROM admitted LEFT JOIN lengths USING (event_id)""",
        "cycle_rows": _cycles_sql() + own[own.rindex(" SELECT event_id, coin, us,"):],
        "telemetry_csv": ticks + V.SQL["spots"] + " SELECT event_id, coin, us, spot, binary_ok, CASE WHEN latency_ms >= 100 THEN 'SLOW;' || coin END AS notes FROM spots",
        "snapshot_records": ticks + V.SQL["snapshots"] + """, sided AS (SELECT event_id, us, CASE WHEN event_id % 61 <> 0 THEN coin END AS ticker, event_id % 59 <> 0 AS active, CASE WHEN event_id % 31 <> 0 THEN bid END AS b, CASE WHEN event_id % 37 <> 0 THEN ask END AS a,
              CASE WHEN event_id % 7 <> 0 THEN mark END AS m, CASE WHEN event_id % 43 <> 0 THEN index_price END AS x FROM snapshots)
            SELECT event_id, ticker, round(CASE WHEN b <= a THEN (b + a) / 2 END, 6) AS mid, concat_ws(';', CASE WHEN ticker IS NULL THEN 'NO_TICKER' END, CASE WHEN b IS NULL OR a IS NULL THEN 'ONE_SIDED' END, CASE WHEN b > a THEN 'CROSSED' END,
              CASE WHEN x IS NULL THEN 'NO_INDEX' END, CASE WHEN NOT active THEN 'NOT_ACTIVE' END) AS problems, CASE WHEN (b IS NULL OR a IS NULL OR b > a) AND m IS NULL THEN 'unavailable' ELSE 'fresh' END AS source_status FROM sided""",
    }
