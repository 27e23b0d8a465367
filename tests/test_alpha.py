import datetime as dt

from pyspark.sql import functions as F

from tickerloom.operators import alpha as A
from tickerloom.operators import cleaning as C


def test_equal_scores_rank_by_symbol(spark):
    rows = [(dt.date(2024, 1, 1), s, 50.0) for s in ("c", "a", "b")]
    top = A.daily_top(spark.createDataFrame(rows, "date date, symbol string, alpha_score double"), 2)
    assert [r["symbol"] for r in top.orderBy("alpha_rank").collect()] == ["a", "b"]


def test_pct_rank_averages_ties_and_skips_missing(spark):
    rows = [(dt.date(2024, 1, 1), s, v) for s, v in (("a", 1.0), ("b", 1.0), ("c", 3.0), ("d", None))]
    got = A.daily_pct_rank(spark.createDataFrame(rows, "date date, symbol string, v double"), {"r": "v"})
    assert {r["symbol"]: r["r"] for r in got.collect()} == {"a": 0.5, "b": 0.5, "c": 1.0, "d": None}


def test_random_samples_are_without_replacement(spark):
    rows = [(dt.date(2024, 1, 1), f"{i:03d}", "T1", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "date date, symbol string, horizon string, ret double")
    everything = A.random_benchmark(df, top_n=9, trials=4).first()
    assert everything["random_count"] == 5
    assert abs(everything["random_avg_return_pct"] - 200.0) < 1e-9 and everything["random_std_return_pct"] < 1e-9
    some = A.random_benchmark(df, top_n=2, trials=4000).first()
    assert abs(some["random_avg_return_pct"] - 200.0) < 5 and some["random_std_return_pct"] > 50


def test_universe_and_history(spark):
    rows = [("600001", 10.0, 90, "ST x", 1.0), ("600002", 10.0, 90, "ok", 1.0), ("300001", 10.0, 90, "ok", 1.0), ("000001", 99.0, 90, "ok", 1.0), ("000002", 9.0, 9, "ok", 1.0)]
    df = spark.createDataFrame(rows, "symbol string, close double, trade_index int, name string, alpha_score double").withColumn("date", F.lit("2024-01-01").cast("date"))
    assert [r["symbol"] for r in C.universe(df).collect()] == ["600002"]
    assert C.universe(df, only_main_board=False, exclude_st=False).count() == 3
    assert C.enough_history(df.withColumn("date", F.col("date")), [1]).count() == 0


def test_cache_columns_are_renamed_on_collision(spark):
    day = dt.date(2024, 1, 1)
    panel = spark.createDataFrame([(day, "a", 1.0, 2.0)], "date date, symbol string, ret_1d_pct double, ma5 double")
    cache = spark.createDataFrame([(day, "a", 9.0, 7.0)], "date date, symbol string, daily_return_pct double, ma5 double")
    row = A.merge_indicators(panel, cache).first()
    assert row["ma5"] == 2.0 and row["ma5_ind"] == 7.0 and row["daily_return_pct_project"] == 1.0
