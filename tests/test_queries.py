"""Every query with SQL agrees with DuckDB on the smallest fitting tables."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
QUICK = ["asof_pair", "cadence", "horizon_observations", "bh_qvalues", "settle_calls", "frozen_score", "gate_replay", "call_dedup", "indicators", "snapshot_records",
         "text_scalars", "market_books", "history_minutes", "symbol_listing", "label_cache", "promotion_journal", "rotated_trades", "retained_rows", "feature_catalog", "missing_reasons", "residual_quintiles", "group_diagnostics", "overlay_preparation", "threshold_evaluation", "recent_report", "backtest_report", "strike_crossings"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.queries()[name](spark, SF)
    expected = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(expected.columns) == columns
    key = lambda r: tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(key([r[c] for c in columns]) for r in got.collect()) == sorted(map(key, expected.select(*columns).fetchall()))


def test_entry_points():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) <= set(entry.queries())
