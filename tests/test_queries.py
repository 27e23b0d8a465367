"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tickerloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PICKED = [
    "bars_weekly", "indicator_table", "forward_labels", "b1_v1_pool", "b2_tdx_pool", "b2_from_b1_pool", "incremental_merge",
    "direction_summary", "extreme_refinement", "extreme_samples", "daily_comparison", "alpha_daily", "feature_ic", "code_export",
    "indicator_resume", "indicator_store", "user_kernels", "event_bars", "stored_window", "pool_release", "factor_group_rows",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", PICKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    exp = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(exp, key=repr)


@pytest.mark.parametrize("name", ["rehydrate", "pool_dirty_bars", "daily_pool_count", "enrich_downtrend", "daily_comparison"])
def test_trades_are_read_once(spark, name):
    assert not any("lineitem" in f for f in QUERIES[name](spark, SF).inputFiles())
