"""Telemetry files, nested records and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.market import finite, mid, price


class SchemaMismatch(ValueError):
    """A file whose header or versions are not the expected ones."""


def write_csv(df: DataFrame, path: str) -> None:
    """Booleans as True and False, lists joined by ;, nulls blank."""

    def text(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "boolean":
            return F.when(c, "True").when(~c, "False").alias(name)
        return F.array_join(c, ";").alias(name) if kind.startswith("array") else c.cast("string").alias(name)

    df.select(*[text(n, k) for n, k in df.dtypes]).write.option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, versions: dict[str, str] | None = None) -> DataFrame:
    """Typed rows of telemetry files.

    The header must be the schema's names in order, and the version columns must hold the given values in every row;
    anything else is an error, as mixed files must not be analysed.  Cells that do not parse are null, and so are
    non-finite numbers.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if raw.columns != schema.names:
        raise SchemaMismatch(f"header {raw.columns} is not {schema.names}")
    for name, value in (versions or {}).items():
        if not raw.where(F.coalesce(F.col(name) != value, F.lit(True))).isEmpty():
            raise SchemaMismatch(f"rows with another {name} than {value}")

    def typed(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "boolean":
            return (F.coalesce(F.lower(F.trim(c)), F.lit("")) == "true").alias(name)
        if kind == "double":
            return finite(c).alias(name)
        return (F.when(c != "", F.split(c, ";")) if kind.startswith("array") else c.try_cast(kind)).alias(name)

    return raw.select(*[typed(f.name, f.dataType.simpleString()) for f in schema.fields])


RECORD = "ticker string, status string, bid struct<price: string, ts_ms: long>, ask struct<price: string, ts_ms: long>, mark struct<price: string, ts_ms: long>, index struct<price: string, ts_ms: long>"


def parse_records(df: DataFrame, column: str) -> DataFrame:
    """Nested provider records as flat snapshots, with what is wrong with them; without any price they are unavailable."""
    r = F.from_json(column, RECORD)
    value = lambda f: price(finite(r[f]["price"]))
    out = df.withColumns({"bid": value("bid"), "ask": value("ask"), "mark": value("mark"), "index_price": value("index"), "ticker": r["ticker"], "market": r["status"]})
    out = out.withColumn("mid", mid(F.col("bid"), F.col("ask")))
    c = F.col
    wrong = F.concat_ws(";", F.when(c("ticker").isNull(), "NO_TICKER"), F.when(c("bid").isNull() | c("ask").isNull(), "ONE_SIDED"), F.when(c("bid") > c("ask"), "CROSSED"), F.when(c("index_price").isNull(), "NO_INDEX"), F.when(F.coalesce(c("market") != "active", F.lit(True)), "NOT_ACTIVE"))
    status = F.when(c("mid").isNull() & c("mark").isNull(), "unavailable").otherwise("fresh")
    return out.withColumn("problems", wrong).withColumn("source_status", status)


def append_new(rows: DataFrame, path: str, keys: list[str], order: str) -> int:
    """Appends to a journal the first row of each key that it does not hold yet; returns how many. Running it again adds none."""
    spark = rows.sparkSession
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*").select(*rows.columns)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        first = first.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh = first.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def last_written(pages: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of the rows of each key in overlapping pages the one written last (the largest ``seq``), and how many there were."""
    values = [c for c in pages.columns if c not in keys]
    return pages.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("r"), F.count("*").alias("versions")).select(*keys, "r.*", "versions")


def resolve_symbols(listing: DataFrame, coins: list[str], overrides: dict[str, str], prefix: str = "") -> DataFrame:
    """(coin, symbol, reason, candidates) for each coin from a listing (symbol, status).

    An override wins.  Else the names that hold the coin are scored by whether they begin with it (after the listing's
    ``prefix``), name a perpetual and are active, in this order; a best score that several names share is AMBIGUOUS,
    a coin without names has NO_MARKET.
    """
    name = F.upper("symbol")
    core = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    named = listing.withColumn("coin", F.explode(F.filter(F.array(*map(F.lit, coins)), lambda c: F.contains(name, c))))
    points = 4 * F.startswith(core, F.col("coin")).cast("int") + 2 * F.contains(name, F.lit("PERP")).cast("int") + F.coalesce(F.col("status") == "active", F.lit(False)).cast("int")
    scored = named.groupBy("coin", points.alias("score")).agg(F.count("*").alias("candidates"), F.min("symbol").alias("first"))
    best = scored.groupBy("coin").agg(F.max_by(F.struct("candidates", "first"), "score").alias("b")).select("coin", "b.*")
    asked = listing.sparkSession.createDataFrame([(c, overrides.get(c)) for c in coins], "coin string, chosen string")
    n = F.coalesce("candidates", F.lit(0))
    symbol = F.coalesce("chosen", F.when(n == 1, F.col("first")))
    reason = F.when(F.col("chosen").isNotNull(), None).when(n == 0, "NO_MARKET").when(n > 1, "AMBIGUOUS")
    return asked.join(best, "coin", "left").select("coin", symbol.alias("symbol"), reason.alias("reason"), n.alias("candidates"))
