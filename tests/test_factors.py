"""The scan of all factors and targets against one pair at a time, and its edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import factors as FA


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        x = round(float(rng.normal()), 2)
        rows.append((
            f"{i % 50:06d}", dt.date(2022, 1, 3) + dt.timedelta(days=i // 50), x, float(rng.integers(0, 2)), float(rng.integers(0, 6)) if i % 3 else None, 7.0,
            float("inf") if i % 9 == 0 else x * x, str(x), float(rng.normal() + 0.3 * x) if i % 7 else None, float(rng.normal()) if i < 400 else None, None))
    schema = "symbol string, date date, a double, flag double, few double, flat double, square double, text string, fwd_return_pct_T1 double, fwd_return_pct_T2 double, fwd_return_pct_T3 double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


TARGETS = ["fwd_return_pct_T1", "fwd_return_pct_T2", "fwd_return_pct_T3"]


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("cells", [1, 4, 64])
def test_scan_equals_pair_by_pair(pool, monkeypatch, cells):
    monkeypatch.setattr(FA, "CELLS", cells)
    summary, detail = FA.analyze_direction(pool, TARGETS, None, 10, 50)
    names = FA.factor_columns(pool, TARGETS)
    assert names == ["a", "flag", "few", "square", "text"]
    plain = FA.bucket_detail(FA.value_buckets(FA.factor_target_rows(pool, names, TARGETS), FA.KEYS, 10, 50))
    assert rows_of(detail) == rows_of(plain.select(*detail.columns))
    got = summary.collect()
    assert len(got) == 10 and summary.columns == ["target_col", *FA.SUMMARY_COLUMNS]
    assert {r["bucket_count_actual"] for r in got if r["factor"] == "flag"} == {2} and {r["target_col"] for r in got} == set(TARGETS[:2])
    places = FA.report_places(summary).orderBy("place").collect()
    assert [(r["factor"], r["target_col"]) for r in places] == [(r["factor"], r["target_col"]) for r in FA.order_summary(summary).collect()]


def test_pools_without_factors_or_rows(pool):
    for poor in (pool.select("symbol", "date", "flat", *TARGETS), pool.where("a > 99")):
        summary, detail = FA.analyze_direction(poor, TARGETS, None, 10, 50)
        assert summary.columns == ["target_col", *FA.SUMMARY_COLUMNS] and summary.collect() == [] and detail.collect() == []
    with pytest.raises(ValueError, match="no target"):
        FA.analyze_direction(pool, ["fwd_return_pct_T9"])
    with pytest.raises(ValueError, match="is no return"):
        FA.analyze_direction(pool.withColumn("fwd_up_T1", F.lit(1)), ["fwd_up_T1"])


def test_nearest_samples_equal_brute_force(pool):
    bounds = [-9.0, -1.005, -0.5, 0.0, 0.2051, 0.2052, 1.5, 99.0]
    detail = pool.sparkSession.createDataFrame(
        [(f, t, i, b, bounds[-1 - i]) for f in ("a", "few") for t in TARGETS for i, b in enumerate(bounds)], "factor string, target_col string, bucket int, min_factor double, max_factor double")
    got = {(r["factor"], r["target_col"], r["bucket"], r["extreme_side"]): (r["match_type"], r["date"], r["symbol"], r["sample_factor_value"]) for r in FA.extreme_samples(pool, detail).collect()}
    table = pool.select("date", "symbol", "a", "few", *TARGETS).toPandas().sort_values(["date", "symbol"])
    want = {}
    for f in ("a", "few"):
        for t in TARGETS:
            mine = table[table[f].notna() & table[t].notna()]
            for i, b in enumerate(bounds):
                for side, bound in (("min", b), ("max", bounds[-1 - i])):
                    away = (mine[f] - bound).abs()
                    if len(mine):
                        exact = away <= max(abs(bound) * 1e-9, 1e-10)
                        row = mine[exact].iloc[0] if exact.any() else mine[away == away.min()].iloc[0]
                        want[f, t, i, side] = ("exact" if exact.any() else "nearest", row["date"], row["symbol"], row[f])
    assert got == want and {x[0] for x in got.values()} == {"exact", "nearest"}
