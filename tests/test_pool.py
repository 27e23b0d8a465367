import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import cleaning as C
from tickerloom.operators import contract as CT
from tickerloom.operators import labels as L
from tickerloom.operators import pool as P
from tickerloom.operators import reports as RP
from tickerloom.operators import strategies as ST
from tickerloom.sources import releases, sinks
from tickerloom.streaming.daily import first_affected_day, merge_months, start_daily_refresh


@pytest.fixture(scope="module")
def pool(bars):
    return P.build_pool(bars, ST.B1_V0, validate=False).cache()


def test_labels_need_a_valid_next_open(spark):
    rows = [("s", dt.date(2024, 1, d), o, c) for d, o, c in ((1, 1.0, 1.0), (2, 0.0, 2.0), (3, 4.0, 5.0))]
    df = L.forward_labels(spark.createDataFrame(rows, "symbol string, date date, open double, close double"), 2)
    got = {r["date"].day: r for r in df.collect()}
    assert got[1]["fwd_return_pct_T1"] is None and got[1]["fwd_up_T1"] is None and got[1]["forward_data_status"] == "missing_t1"
    assert got[2]["fwd_return_pct_T1"] == pytest.approx(25.0) and got[2]["forward_data_status"] == "partial_missing"
    assert got[3]["t1_date"] is None and got[3]["forward_data_status"] == "missing_t1"


def test_pool_passes_its_contract(pool):
    report = CT.validate_pool(pool, ST.B1_V0)
    assert report.row_count == pool.count() > 10
    assert "kdj_j" in report.factor_columns and "ma20" not in report.factor_columns


def test_contract_lists_all_violations(pool):
    bad = pool.drop("open").withColumns({
        "score": F.lit(1), "fwd_secret": F.lit(1.0), "t21_high": F.lit(1.0), "selection_strategy": F.lit("other"),
        "t5_date": F.lit(None).cast("date"), "volume": F.lit("many"),
    })
    with pytest.raises(ValueError) as e:
        CT.validate_pool(bad, ST.B1_V0)
    for word in ("'open'", "score", "fwd_secret", "t21_high", "other strategies", "t5_date", "no numbers in volume"):
        assert word in str(e.value)


def test_refreshed_window_equals_full_build(bars, pool):
    start = "2022-05-01"
    old = P.build_pool(bars, ST.B1_V0, end_date="2022-06-30", validate=False)
    new = P.build_pool(bars, ST.B1_V0, start_date=start, validate=False)
    cols = ["symbol", "date", "kdj_j", "ma60", "fwd_return_pct_T20", "forward_data_status"]
    merged = P.merge_window(old, new, start, "2100-01-01")
    assert sorted(map(tuple, merged.select(*cols).collect()), key=str) == sorted(map(tuple, pool.select(*cols).collect()), key=str)


def test_normalize_merges_versions_and_drops_scores(spark):
    df = spark.createDataFrame(
        [("1", None, 2.0, 1.0, 9, "3.5", "x")], "symbol string, a double, b2v1_a double, b2v2_score_total double, score int, n string, note string")
    row = P.normalize_schema(df).first().asDict()
    assert row == {"symbol": "000001", "a": 2.0, "n": 3.5, "note": "x"}


def test_windows_and_calendar_errors(bars, pool):
    w = P.resolve_window(bars, pool, incremental=True)
    assert w.mode == "incremental_refresh_window" and w.start == w.old_pool_max - dt.timedelta(days=45)
    assert P.resolve_window(bars, incremental=True).mode == "incremental_no_existing_pool_full_build"
    with pytest.raises(RuntimeError, match="too early"):
        P.resolve_window(bars, end_date="2030-01-01")
    with pytest.raises(RuntimeError, match="no trading day"):
        P.resolve_window(bars.filter("date != '2022-02-02'"), end_date="2022-02-02")
    with pytest.raises(RuntimeError, match="lacks"):
        P.preflight(bars, bars, w, ST.B1_V0)


def test_strategies_are_registered_once(bars):
    assert ST.strategy_names() == sorted([ST.B1_V0, ST.B1_V1, ST.B2_INLINE, ST.B2_FROM_B1])
    with pytest.raises(ValueError):
        ST.register(ST.stage_low_v0)
    with pytest.raises(KeyError):
        ST.get_strategy("nope")
    everything = ST.stage_low_v0(bars, keep_all=True)
    assert everything.count() == bars.count()
    assert everything.filter("selected = 1").count() == ST.stage_low_v0(bars).count()


def test_stored_pool_is_refreshed_in_place(spark, bars, tmp_path):
    path = str(tmp_path / "pool")
    sinks.write_pool(P.build_pool(bars, ST.B1_V0, end_date="2022-06-30", validate=False), path, ST.B1_V0, csv=True, note="first")
    before = sinks.read_pool(spark, path)
    rows = before.count()
    window = P.resolve_window(bars, before, incremental=True)
    sinks.refresh_pool(P.build_pool(bars, ST.B1_V0, start_date=window.start, validate=False), path, ST.B1_V0, window)
    full = P.build_pool(bars, ST.B1_V0, validate=False)
    assert sinks.read_pool(spark, path).count() == full.count() > rows == before.count()
    facts = releases.current(spark, path).facts
    assert (facts["strategy_name"], facts["rows"], facts["note"]) == (ST.B1_V0, full.count(), "first")
    assert releases.read(spark, path, "csv").count() == full.count()
    # Old months stay readable until they are cleared; then only folders of the newest release are left.
    assert releases.vacuum(spark, path, keep=1) >= 1
    assert sinks.read_pool(spark, path).count() == full.count()


def test_emptied_months_leave_the_stored_pool(spark, bars, pool, tmp_path):
    path = str(tmp_path / "pool")
    sinks.write_pool(pool, path, ST.B1_V0)
    window = P.resolve_window(bars, start_date="2022-05-01", end_date="2022-06-30", incremental=True)
    new = pool.filter("date BETWEEN '2022-05-01' AND '2022-05-31'")
    counts = {r["src"]: r["rows_in_window"] for r in sinks.refresh_pool(new, path, ST.B1_V0, window).collect()}
    want = pool.filter("date NOT BETWEEN '2022-06-01' AND '2022-06-30'")
    keys = lambda df: sorted(map(tuple, df.select("symbol", "date").collect()))
    assert keys(sinks.read_pool(spark, path)) == keys(want) and want.count() < pool.count()
    assert "2022-06" not in releases.current(spark, path).tables["pool"].parts
    assert counts["final"] == new.count() < counts["old"]


def test_a_broken_pool_or_a_crash_leaves_the_old_release(spark, bars, pool, tmp_path, monkeypatch):
    path = str(tmp_path / "pool")
    sinks.write_pool(pool, path, ST.B1_V0)
    keys = lambda: sorted(map(tuple, sinks.read_pool(spark, path).select("symbol", "date").collect()))
    exact = keys()
    bad = pool.filter("date > '2022-06-01'").withColumn("selection_strategy", F.lit("other"))
    with pytest.raises(ValueError, match="other strategies"):
        sinks.write_pool(bad, path, ST.B1_V0)
    with pytest.raises(ValueError, match="other strategies"):
        sinks.refresh_pool(bad, path, ST.B1_V0, P.resolve_window(bars, start_date="2022-06-02", incremental=True))
    assert keys() == exact
    # The crash comes between the tables of a release: pool and csv are written, the manifest is not.
    monkeypatch.setattr(releases, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError, match="crash"):
        sinks.write_pool(pool.filter("date > '2022-06-01'"), path, ST.B1_V0, csv=True)
    assert keys() == exact
    monkeypatch.undo()
    late = releases.current(spark, path)
    releases.commit(spark, path, late, late.tables, late.facts)
    with pytest.raises(RuntimeError, match="another writer"):
        releases.commit(spark, path, late, late.tables, late.facts)


def test_empty_pool_is_a_release(spark, pool, tmp_path):
    path = str(tmp_path / "pool")
    sinks.write_pool(pool.filter("date > '2100-01-01'"), path, ST.B1_V0)
    assert sinks.read_pool(spark, path).collect() == [] and releases.current(spark, path).facts["rows"] == 0


def test_six_alpha_tables_switch_together(spark, tmp_path, monkeypatch):
    def tables(n):
        one = spark.createDataFrame([(dt.date(2022, 1, 3), "000001", n)], "date date, symbol string, alpha_rank int")
        return {"top": one, "daily": one, "monthly": one, "summary": one, "rank_ic": one, "feature_ic": one}

    path = str(tmp_path / "alpha")
    seen = lambda: {n: [r["alpha_rank"] for r in releases.read(spark, path, n).collect()] for n in releases.current(spark, path).tables}
    sinks.write_alpha(path, **tables(1))
    first = seen()
    assert len(first) == 6 and set(map(tuple, first.values())) == {(1,)}
    stage, calls = releases.stage, []

    def failing(*a, **k):
        calls.append(a)
        if len(calls) == 4:
            raise OSError("crash between tables")
        return stage(*a, **k)

    monkeypatch.setattr(releases, "stage", failing)
    with pytest.raises(OSError):
        sinks.write_alpha(path, **tables(2))
    assert seen() == first
    monkeypatch.undo()
    sinks.write_alpha(path, **tables(3))
    assert set(map(tuple, seen().values())) == {(3,)}


def test_direction_and_indicator_releases(spark, bars, tmp_path):
    path = str(tmp_path / "direction")
    summary = spark.createDataFrame([("a", "neutral", 1.5), ("b", "cap_high_values", 2.5), ("c", "neutral", 0.5)], "factor string, action_hint string, x double")
    sinks.write_direction(summary, summary.drop("action_hint"), path, summary)
    assert {r["factor"] for r in releases.read(spark, path, "indicator_factors", ["neutral"]).collect()} == {"a", "c"}
    assert sorted(r["x"] for r in releases.read(spark, path, "indicator_summary").collect()) == [0.5, 1.5, 2.5]
    table = str(tmp_path / "indicators")
    sinks.write_indicators(bars, table, lookback=5)
    facts = releases.current(spark, table).facts
    assert (facts["rows"], facts["symbols"], facts["lookback"]) == (bars.count(), 3, 5)


def test_stream_lands_bars_and_refreshes(spark, bars, tmp_path):
    early, late = bars.filter("date <= '2022-08-31'"), bars.filter("date > '2022-08-31'")
    paths = {k: str(tmp_path / k) for k in ("landing", "bars", "pool", "ckpt")}
    merge_months(spark, early, paths["bars"], str(tmp_path / "first"))
    sinks.write_pool(P.build_pool(early, ST.B1_V0, validate=False), paths["pool"], ST.B1_V0)
    late.write.parquet(paths["landing"])
    start_daily_refresh(spark, paths["landing"], paths["bars"], paths["pool"], ST.B1_V0, paths["ckpt"]).awaitTermination()
    full = P.build_pool(bars, ST.B1_V0, validate=False).select("symbol", "date", "forward_data_status")
    got = sinks.read_pool(spark, paths["pool"]).select("symbol", "date", "forward_data_status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))


def test_months_survive_a_crash_between_the_two_writes(spark, bars, tmp_path):
    early, late = bars.filter("date <= '2022-08-31'"), bars.filter("date > '2022-08-20'").withColumn("close", F.col("close") * 1.5)
    table, staged = str(tmp_path / "bars"), str(tmp_path / "staged")
    merge_months(spark, early, table, str(tmp_path / "first"))
    merge_months(spark, late, table, staged)
    exact = sorted(map(tuple, spark.read.parquet(table).select("symbol", "date", "close").collect()))
    # The crash: a touched month is gone; the batch is replayed without its old rows.
    lost = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/month=2022-08")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, True)
    merge_months(spark, late, table, staged)
    assert sorted(map(tuple, spark.read.parquet(table).select("symbol", "date", "close").collect())) == exact


def test_changed_bars_reach_twenty_bars_back(spark):
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=7 * i) for i in range(60)]
    table = spark.createDataFrame([(s, d) for s in ("a", "b") for d in days], "symbol string, date date")
    changed = spark.createDataFrame([("a", days[45])], "symbol string, date date")
    assert first_affected_day(table, changed) == days[25]


def test_exchange_symbols_confirm_and_enrich(spark, bars, pool):
    b1 = pool.select("symbol", "date")
    loose = {"return_threshold_pct": -50.0, "min_volume_ratio_prev1": 0.0, "j_max": 1e9}
    plain = P.build_pool(bars, ST.B2_FROM_B1, b1_pool=b1, with_range=True, **loose)
    marked = bars.withColumn("symbol", F.concat(F.lit("SH#"), "symbol"))
    exchange = P.build_pool(marked, ST.B2_FROM_B1, b1_pool=b1, with_range=True, **loose)
    keys = lambda df: sorted(map(tuple, df.select("symbol", "date", "b1_date").collect()))
    assert keys(exchange) == keys(plain) and len(keys(plain)) > 0
    flag = "b1_structure_downtrend_40"
    assert sorted(map(tuple, P.enrich_downtrend(b1, marked).collect())) == sorted(map(tuple, P.enrich_downtrend(b1, bars).collect()))
    assert P.enrich_downtrend(b1, marked).columns == [*b1.columns, flag]


def test_inline_confirmation_needs_one_exchange(bars):
    plan = P.build_pool(bars, ST.B2_INLINE, validate=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and plan.count("FlatMapGroupsInArrow") == 1
    loose = {"return_min_pct": -50.0, "j_max": 1e9, "upper_shadow_max": 1e9, "position_max": 0.9, "j_low_max": 60.0, "quiet_ratio_max": 9.0, "signal_window": 3}
    got = P.build_pool(bars, ST.B2_INLINE, validate=False, **loose).collect()
    assert got and all(1 <= r["b1_lag_trade_days"] <= 3 and r["b1_date"] == r["date"] - dt.timedelta(days=r["b1_lag_trade_days"]) for r in got)


def test_selected_text_without_numbers_is_read_by_truth(spark):
    rows = [("1", 1), ("0", 2), ("", 3), (None, 4)]
    df = spark.createDataFrame(rows, "selected string, id int")
    assert [r["id"] for r in C.selected_rows(df).collect()] == [1]
    words = spark.createDataFrame([("yes", 1), ("", 2), (None, 3)], "selected string, id int")
    assert [r["id"] for r in C.selected_rows(words).collect()] == [1]


def test_combination_cuts_follow_distinct_values(spark):
    rows = [(v, 1.0, 10.0, 11.0) for v, n in ((0.0, 70), (1.0, 10), (2.0, 10), (3.0, 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "f double, fwd_return_pct_T1 double, close double, t1_open double")
    sizes = [RP.combination_rows(df, {"f": [b]}, 10).count() for b in (1, 2, 3)]
    assert sizes == [80, 20, 0]
    detail = spark.createDataFrame([("f", 1), ("f", 4), ("g", 1)], "factor string, bucket int")
    assert RP.bucket_counts(detail) == {"f": 4, "g": 2}
    assert "t1_open_gap_pct" in RP.combination_rows(df.withColumn("t1_open", F.rand(3)), {"t1_open_gap_pct": [1]}, 4).columns
