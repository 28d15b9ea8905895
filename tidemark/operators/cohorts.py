"""Which telemetry rows stand for a market: at fixed times before its close, or at its first signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark import config as C
from tidemark.operators import scans
from tidemark.operators.timewin import SLICE
from tidemark.shipping import ship
from tidemark.sources.views import SECOND


def inconsistent_tickers(observed: DataFrame) -> DataFrame:
    """Per ticker the coins, closes and rows seen, and why it is excluded (null: it is not)."""
    meta = observed.groupBy("ticker").agg(F.count_distinct("coin").alias("coins"), F.count_distinct("close_us").alias("closes"), F.count("*").alias("n_rows"), F.min("us").alias("first_us"))
    return meta.withColumn("reason", F.when((F.col("coins") > 1) | (F.col("closes") != 1), "INCONSISTENT_METADATA"))


def horizon_rows(observed: DataFrame, minutes: tuple[int, ...] = C.HORIZON_MINUTES, early: int = C.HORIZON_EARLY) -> DataFrame:
    """Per labelled ticker and horizon the latest row at or before the target, at most ``early`` seconds before it."""
    grid = observed.where(F.col("up").isNotNull()).withColumn("horizon", F.explode(F.array(*map(F.lit, minutes))))
    grid = grid.withColumn("early_us", F.col("close_us") - F.col("horizon") * 60 * SECOND - F.col("us"))
    usable = grid.where(F.col("early_us").between(0, early * SECOND))
    newest = F.max_by(F.struct(*[c for c in usable.columns if c not in ("ticker", "horizon")]), F.struct("us", "row_id"))
    return usable.groupBy("ticker", "horizon").agg(newest.alias("r")).select("ticker", "horizon", "r.*")


def first_signals(observed: DataFrame, window: tuple[int, int] = C.ENTRY_MINUTES) -> DataFrame:
    """Per labelled ticker its first signal row inside the entry window."""
    left = (F.col("close_us") - F.col("us")) / (60 * SECOND)
    rows = observed.where(F.col("up").isNotNull() & F.col("signal") & left.between(*window))
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "ticker"]), F.struct("us", "row_id"))
    return rows.groupBy("ticker").agg(first.alias("r")).select("ticker", "r.*")


def merge_labels(cache: DataFrame, results: DataFrame, as_of_us: int, grace: int = 90) -> DataFrame:
    """One step of the label state machine.

    ``cache`` (ticker, coin, close_us, outcome, status) is joined with ``results`` (ticker, coin, close_us, result, error).
    A final label never changes: a different result makes a conflict, and metadata that disagree make a
    metadata conflict.  A market is not asked for before ``grace`` seconds after its close.
    """
    c, r = cache.alias("c"), results.alias("r")
    both = c.join(r, F.col("c.ticker") == F.col("r.ticker"), "full_outer")
    text = F.lower(F.trim("r.result"))
    outcome = F.when(text == "yes", 1).when(text == "no", 0)
    close = F.coalesce("c.close_us", "r.close_us")
    was_final = F.coalesce(F.col("c.status") == "final", F.lit(False))
    differs = (F.col("c.coin") != F.col("r.coin")) | (F.col("c.close_us") != F.col("r.close_us"))
    status = (
        F.when(F.coalesce(differs, F.lit(False)), "metadata_conflict")
        .when(F.col("c.status").isin("conflict", "metadata_conflict"), F.col("c.status"))
        .when(was_final & outcome.isNotNull() & (outcome != F.col("c.outcome")), "conflict")
        .when(was_final, "final")
        .when(close + grace * SECOND > as_of_us, "pending")
        .when(F.col("r.error").isNotNull(), "error")
        .when(outcome.isNotNull(), "final")
        .when(F.coalesce(text, F.lit("")) != "", "unexpected_result")
        .otherwise("pending")
    )
    kept = F.when(was_final, F.col("c.outcome")).when(status == "final", outcome)
    return both.select(F.coalesce("c.ticker", "r.ticker").alias("ticker"), F.coalesce("c.coin", "r.coin").alias("coin"), close.alias("close_us"), kept.cast("int").alias("outcome"), status.alias("status"))


def thin(times: list[int], spacing: int, usable: list[bool]) -> list[int]:
    """Positions kept greedily: each usable one at least ``spacing`` after the last kept."""
    kept, last = [], None
    for i, t in enumerate(times):
        if usable[i] and (last is None or t - last >= spacing):
            kept.append(i)
            last = t
    return kept


def _later(us: np.ndarray, part: np.ndarray, at: np.ndarray, h: int, tolerance: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) rows ``at`` of those at ``us``, which rise, have a row ``h`` later in the same ``part``."""
    found, pick = np.empty(len(at), bool), np.empty(len(at), np.int64)
    for i in range(0, len(at), SLICE):
        own = at[i : i + SLICE]
        t = us[own]
        a = np.maximum(np.searchsorted(us, t + max(1, (h - tolerance) * second), "left"), np.searchsorted(part, part[own], "left"))
        b = np.minimum(np.searchsorted(us, t + (h + tolerance) * second, "right"), np.searchsorted(part, part[own], "right"))
        target = np.searchsorted(us, t + h * second, "right")
        # the last time up to the target and the first one after it
        before, after = np.minimum(target, b) - 1, np.maximum(target, a)
        has_before, has_after = before >= a, after < b
        before, after = np.maximum(before, 0), np.minimum(after, len(us) - 1)
        first = has_before & (~has_after | (t + h * second - us[before] <= us[after] - t - h * second))
        found[i : i + SLICE] = has_before | has_after
        pick[i : i + SLICE] = np.where(first, np.searchsorted(us, us[before], "left"), after)
    return found, pick


def nearest_later(rows: DataFrame, key: list[str], horizons: tuple[int, ...], tolerance: int, second: int) -> DataFrame:
    """(key, event_id, us, horizon, label_us, later) of ready rows that have an observation about the horizon later.

    That is the nearest to the target within ``tolerance``, strictly later and of the same ``run``; of two as near the
    earlier one, of one time that with the lowest spot.  Rows are met by binary search in time buckets with what follows.
    """
    reach = (max(horizons) + tolerance) * second
    own = F.floor(F.col("us") / (8 * reach))
    spread = rows.select(*key, "event_id", "us", "spot", "run", "ready").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("us") - reach) / (8 * reach)), own))).withColumn("own", F.col("bucket") == own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        head = [pa.scalar(table[c][0].as_py(), table.schema.field(c).type) for c in key]
        us, spot, part, mine = (table[c].to_numpy() for c in ("us", "spot", "run", "own"))
        mine = mine.astype(bool) & np.array(table["ready"].fill_null(False).to_numpy(), bool)
        order = np.lexsort((spot, us))
        us, spot, part, mine, ids = us[order], spot[order].astype(float), part[order], mine[order], table["event_id"].to_numpy()[order]
        del table
        # runs are stretches of time, as rows of one time are of one run
        at = np.nonzero(mine)[0]
        for i in range(0, len(at), SLICE):
            rows_at = at[i : i + SLICE]
            for h in horizons:
                found, pick = _later(us, part, rows_at, h, tolerance, second)
                n, kept = int(found.sum()), rows_at[found]
                columns = [pa.repeat(x, n) for x in head] + [pa.array(x) for x in (ids[kept], us[kept], np.full(n, h, np.int32), us[pick[found]], spot[pick[found]])]
                yield pa.RecordBatch.from_arrays(columns, [*key, "event_id", "us", "horizon", "label_us", "later"])

    ship(rows.sparkSession)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in (*key, "event_id"))
    return spread.groupBy(*key, "bucket").applyInArrow(run, kinds + "us long, horizon int, label_us long, later double")


def leadlag_anchors(features: DataFrame, horizons: tuple[int, ...], scale: int, tolerance: int = C.LEADLAG_TOLERANCE, gap: int = C.LEADLAG_GAP) -> DataFrame:
    """Ready rows with the spot return to an observation about each horizon later, thinned to one per horizon; other columns stay.

    The later observation is the nearest to the target within ``tolerance``, strictly later, in the same session and
    coin, with no gap over ``gap`` in between; an earlier one wins ties.  Rows go by time buckets with what follows as far
    as a horizon reaches, so gaps, later rows and what a bucket does to the thinning (``scans.doors``) are found there
    for all horizons.  Only doors leave the first pass, only the rows kept the second one, in which a bucket knows where it
    is entered.  ``features`` are read twice and should be written.
    """
    second, key = scale * SECOND, ["session", "coin"]
    reach = (max(horizons) + tolerance) * second
    width = 2 * reach
    others = [c for c in features.columns if c not in (*key, "us", "event_id", "spot", "ready")]
    spread = features.withColumn("bucket", F.explode(F.sequence(scans.begin(F.col("us") - reach, width), scans.begin(F.col("us"), width), F.lit(width))))

    def usable(table: pa.Table) -> tuple[pa.Table, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """(rows by time and spot; by horizon the rows of the bucket that count, one a time, and their later rows)."""
        table = table.take(pa.array(np.lexsort((table["spot"].to_numpy(), table["us"].to_numpy())))).combine_chunks()
        us, start = table["us"].to_numpy(), table["bucket"][0].as_py()
        part = np.cumsum(np.diff(us, prepend=us[:1]) > gap * second)
        at = np.nonzero(table["ready"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & (us >= start) & (us < start + width))[0]
        at = at[np.lexsort((table["event_id"].to_numpy()[at], us[at]))]
        at = at[np.concatenate((np.ones(min(len(at), 1), bool), np.diff(us[at]) > 0))]
        met = {}
        for h in horizons:
            found, pick = _later(us, part, at, h, tolerance, second)
            met[h] = at[found], pick[found]
        return table, met

    def whole(table: pa.Table) -> pa.Table:
        table, met = usable(table)
        us, start, parts = table["us"].to_numpy(), table["bucket"][0].as_py(), []
        for h, (at, _) in met.items():
            entry, out = scans.doors(us[at], h * second, start)
            head = {c: pa.repeat(pa.scalar(table[c][0].as_py(), table.schema.field(c).type), len(entry)) for c in (*key, "bucket")}
            parts.append(pa.table({"horizon": pa.array(np.full(len(entry), h, np.int32)), **head, "entry": pa.array(entry), "reach": pa.array(out)}))
        return pa.concat_tables(parts)

    def follow(table: pa.Table, opened: pa.Table) -> pa.Table:
        parts = [empty]
        if len(table) and len(opened):
            table, met = usable(table)
            us = table["us"].to_numpy()
            for h, begun in zip(opened["horizon"].to_pylist(), opened["reach"].to_pylist()):
                at, pick = met[h]
                i = scans.kept(us[at], h * second, begun)
                rows, later = table.take(pa.array(at[i])), table.take(pa.array(pick[i]))
                added = {"horizon": pa.array(np.full(len(i), h, np.int32)), "label_us": later["us"], "later": later["spot"]}
                parts.append(pa.table({c: added[c] if c in added else rows[c] for c in empty.column_names}).cast(empty.schema))
        return pa.concat_tables(parts)

    ship(features.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    head = "".join(f"`{c}` {kinds[c]}, " for c in key)
    found = spread.select(*key, "bucket", "us", "event_id", "spot", "ready").groupBy(*key, "bucket").applyInArrow(whole, f"horizon int, {head}bucket long, entry long, reach long")
    opened = scans.entered(found, ["horizon", *key], width)
    schema = f"horizon int, {head}us long, event_id {kinds['event_id']}, spot double, label_us long, later double" + "".join(f", `{c}` {kinds[c]}" for c in others)
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    out = spread.groupBy(*key, "bucket").cogroup(opened.groupBy(*key, "bucket")).applyInArrow(follow, schema)
    return out.select(*key, "us", "event_id", "spot", "label_us", ((F.col("later") / F.col("spot") - 1) * 10000).alias("y"), *others, "horizon")
