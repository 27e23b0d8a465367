"""Work that goes on from stored state: bucketed bars, resumed indicators, event streams."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions.recursive import Average, Previous, evaluate, remembered
from tickerloom.operators import indicators as I
from tickerloom.sources import sinks
from tickerloom.streaming import events as EV


def rounded(df, columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def test_bucketed_bars_need_no_exchange(spark, bars):
    stored = sinks.save_by_symbol(bars, f"bars_{uuid.uuid4().hex}", buckets=4)
    table = I.indicator_table(stored, extra={}, bucketed=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    columns = I.indicator_table(bars, extra={}).columns
    assert rounded(table, columns) == rounded(I.indicator_table(bars, extra={}), columns)


@pytest.mark.parametrize("split", [[1, 30, 31, 32, 120], [200], [59, 60, 61]])
def test_resumed_steps_equal_one_pass(spark, bars, split):
    first = dt.date(2022, 1, 3)
    days = [first, *[first + dt.timedelta(days=n) for n in split], dt.date(2100, 1, 1)]
    state, rows = None, None
    for low, high in zip(days[:-1], days[1:], strict=True):
        part, state = I.resume_indicators(state, bars.where((F.col("date") >= F.lit(low)) & (F.col("date") < F.lit(high))))
        rows = part if rows is None else rows.unionByName(part)
    full = I.run(bars, I.indicator_block())
    assert rounded(rows, full.columns) == rounded(full, full.columns)
    assert {(r["symbol"], r["seen"]) for r in state.collect()} == {("000001", 260), ("600002", 150), ("300003", 40)}
    with pytest.raises(ValueError, match="rebuild"):
        I.resume_indicators(state, bars.where("date = DATE '2022-01-20'"))
    none, same = I.resume_indicators(state, bars.where("false"))
    assert none.count() == 0 and same.count() == 3


def test_memory_of_averages_with_gaps():
    rng = np.random.default_rng(1)
    steps = [Average("d", "x", 0.3), Average("h", "x", 0.25, "hold"), Average("dd", "d", 0.5), Previous("p", "dd")]
    for _ in range(200):
        x = pd.Series(np.where(rng.random(30) < rng.random(), np.nan, rng.normal(size=30)))
        whole = evaluate(steps, {"x": x})
        memory, parts = {}, []
        for low, high in zip([0, *sorted(rng.integers(0, 31, 3))], [*sorted(rng.integers(0, 31, 3)), 30], strict=True):
            low = sum(len(p["x"]) for p in parts)
            piece = x.iloc[low:max(low, high)].reset_index(drop=True)
            done = evaluate(steps, {"x": piece}, memory)
            memory = remembered(steps, done, memory)
            parts.append(done)
        for s in steps:
            joined = np.concatenate([p[s.name].to_numpy() for p in parts])
            np.testing.assert_allclose(joined, whole[s.name].to_numpy()[:len(joined)], rtol=1e-12)


HOURS = [dt.datetime(2024, 1, 1, h, m) for h in range(24) for m in (5, 35)]


def event(i, ts, value=1.0, kind="a"):
    return (i, ts, 1, kind, value)


def take(spark, folder, rows):
    spark.createDataFrame(rows, EV.EVENT_SCHEMA).write.mode("append").parquet(f"{folder}/in")
    EV.take_landed(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress", delay="2 hours")


def bars_of(spark, folder):
    return {r["start"]: (r["open"], r["high"], r["low"], r["close"], r["volume"], r["events"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def test_events_restart_late_and_twice(spark, tmp_path):
    folder = str(tmp_path)
    rows = [event(i, ts, float(i)) for i, ts in enumerate(HOURS)]
    take(spark, folder, rows[:20])  # until 9:35, so the mark is 7:35
    assert sorted(bars_of(spark, folder)) == [dt.datetime(2024, 1, 1, h) for h in range(7)]
    # The stream has stopped; it goes on with late events (dropped), repeated ones (once), and one out of order (kept).
    take(spark, folder, [event(900, HOURS[3], 99.0), rows[18], rows[19], event(901, dt.datetime(2024, 1, 1, 8, 59), -5.0), *rows[20:30]])
    got = bars_of(spark, folder)
    assert got[dt.datetime(2024, 1, 1, 1)] == (2.0, 3.0, 2.0, 3.0, 5.0, 2)
    assert got[dt.datetime(2024, 1, 1, 8)] == (16.0, 17.0, -5.0, -5.0, 28.0, 3)
    assert got[dt.datetime(2024, 1, 1, 9)] == (18.0, 19.0, 18.0, 19.0, 37.0, 2)
    # Nothing new: nothing is written again.
    EV.take_landed(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress", delay="2 hours")
    assert bars_of(spark, folder) == got
    table = spark.createDataFrame([*rows, rows[3], event(None, HOURS[0]), event(5000, None), event(5001, HOURS[0], None)], EV.EVENT_SCHEMA)
    assert EV.windowed_bars(table).count() == 24 and EV.windowed_bars(table).agg(F.sum("events")).first()[0] == len(rows)
