import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions.recursive import Average, Kernel, Mix, evaluate
from tickerloom.operators import audit as AU
from tickerloom.operators import cleaning as C
from tickerloom.operators import indicators as I
from tickerloom.operators import pool as P
from tickerloom.operators import strategies as ST
from tickerloom.sources import releases, sinks


def by_hand(df):
    return df.orderBy("symbol", "date").toPandas()


def close_to(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


def test_missing_values_decay_or_hold():
    x = pd.Series([np.nan, 10.0, np.nan, 20.0])
    out = evaluate([Average("decay", "x", 0.5), Average("hold", "x", 0.5, "hold"), Mix("d", "decay", "hold")], {"x": x})
    close_to(out["decay"], [np.nan, 10.0, 10.0, (0.25 * 10 + 0.5 * 20) / 0.75])
    close_to(out["hold"], [np.nan, 10.0, 10.0, 15.0])
    close_to(out["d"], np.asarray(out["decay"]) - np.asarray(out["hold"]))


def test_recursive_columns_match_a_plain_loop(bars):
    got = by_hand(I.run(bars, I.macd() + I.kdj_loose() + I.renko() + I.z_trend()))
    for _, g in got.groupby("symbol"):
        def ema(v, n):
            out, a = [], 2 / (n + 1)
            for x in v:
                out.append(x if not out else a * x + (1 - a) * out[-1])
            return np.array(out)

        dif = ema(g.close, 12) - ema(g.close, 26)
        close_to(g.macd_dif, dif)
        close_to(g.macd_hist, dif - ema(dif, 9))
        close_to(g.z_short_trend_line, ema(ema(g.close, 10), 10))
        high, low = g.high.rolling(9, min_periods=3).max(), g.low.rolling(9, min_periods=3).min()
        rsv = ((g.close - low) / (high - low).replace(0, np.nan) * 100).clip(0, 100)
        k = rsv.ewm(alpha=1 / 3, adjust=False).mean()
        close_to(g.kdj_k, k)
        close_to(g.kdj_j, 3 * k - 2 * k.ewm(alpha=1 / 3, adjust=False).mean())
        assert (g.renko_value >= 0).all()


def test_flat_range_is_missing_or_zero(bars):
    flat = F.col("date").between(F.lit("2022-03-12"), F.lit("2022-03-16")) & (F.col("symbol") == "000001")
    loose = I.run(bars, I.kdj_loose()).filter(flat).agg(F.countDistinct(F.round("kdj_k", 9)).alias("n")).first()
    strict = I.run(bars, I.kdj_strict()).filter(flat).agg(F.max("kdj_k") - F.min("kdj_k")).first()
    assert loose["n"] == 1 and strict[0] > 0


def test_first_bar_zero_volume_and_warmup(bars):
    got = by_hand(I.indicator_table(bars, extra={}))
    first = got.groupby("symbol").head(1)
    assert first.daily_return_pct.isna().all() and first.ma5.notna().all()
    assert got.groupby("symbol").ma60.apply(lambda s: s.isna().sum()).tolist() == [19, 19, 19]
    sixth = got.groupby("symbol").nth(6)
    assert sixth.volume_ratio_prev1.isna().all()


def test_low_volume_count_and_downtrend(bars):
    got = by_hand(I.downtrend(I.low_volume_count(bars), 20))
    for _, g in got.groupby("symbol"):
        exp = g.volume.rolling(20).apply(lambda v: (v >= v[-1]).sum(), raw=True)
        close_to(g.low_volume_count, exp)
        high, low = g.high.rolling(20).max(), g.low.rolling(20).min()
        down = (high < high.shift(20) * 0.99) & (low < low.shift(20) * 0.97)
        assert g.b1_structure_downtrend_20.tolist() == down.astype(int).tolist()


def test_start_date_keeps_history(bars):
    full = I.indicator_table(bars, extra={}).filter("date >= '2022-05-01'")
    cut = I.indicator_table(bars, start_date="2022-05-01", extra={})
    close_to(by_hand(full).macd_dea, by_hand(cut).macd_dea)


def test_audit_finds_every_breach(bars):
    good = bars.withColumn("typical", (F.col("high") + F.col("low")) / 2)
    assert AU.audit(bars, good).ok
    bad = (
        bars.filter("symbol != '300003'").withColumn("close", F.col("close") + 1).withColumn("close_to_x", F.lit(1.0))
        .withColumn("up", F.lit(True)).withColumn("tag", F.lit("a")).withColumn("none", F.lit(None).cast("double"))
        .withColumn("wild", F.lit(float("inf"))).drop("amount")
    )
    text = " ".join(AU.audit(bars, bad).errors)
    for word in ("rows became", "changed in", "close_to_x", "truth values", "no numbers", "without a value", "infinite", "are gone", "a bar needs"):
        assert word in text
    with pytest.raises(ValueError, match="failed its audit"):
        AU.apply_audited(bars, {"broken": lambda d: d.withColumn("up", F.lit(True))})


def test_plug_ins_are_audited_and_get_named_settings(bars):
    def wide(df, ma_windows):
        return df.withColumn("widest", F.lit(max(ma_windows)) + F.col("close"))

    def after(df):
        return df.withColumn("twice", F.col("widest") * 2)

    row = I.indicator_table(bars, ma_windows=(5, 9), extra={"wide": wide, "after": after}).first()
    assert row["widest"] == row["close"] + 9 and row["twice"] == 2 * row["widest"]
    with pytest.raises(ValueError, match="changed in"):
        I.indicator_table(bars, extra={"bad": lambda df: df.withColumn("close", F.col("close") * 2)})


def _kernels():
    def mean(a):
        return {"mid_price": (a["high"] + a["low"]) / 2}

    def on_top(a):
        return {"mid_lag": np.concatenate(([np.nan], a["mid_price"][:-1])), "k_turn": np.diff(a["kdj_like"], prepend=np.nan) if "kdj_like" in a else a["macd_dif"] * 2}

    return [I.Kernel("mid", ("high", "low"), ("mid_price",), mean), I.Kernel("top", ("mid_price", "macd_dif"), ("mid_lag", "k_turn"), on_top)]


def test_kernels_share_the_pass(spark, bars):
    plain, more = I.indicator_table(bars, extra={}, kernels=[]), I.indicator_table(bars, extra={}, kernels=_kernels())
    count = lambda df, word: df._jdf.queryExecution().executedPlan().toString().count(word)
    assert count(plain, "Exchange") == count(more, "Exchange") > 0 and count(more, "FlatMapGroupsInArrow") == 1
    assert more.columns == [*plain.columns, "mid_price", "mid_lag", "k_turn"]
    rows = more.where("symbol = '600002'").orderBy("date").collect()
    assert all(abs(r["mid_price"] - (r["high"] + r["low"]) / 2) < 1e-12 for r in rows)
    assert rows[0]["mid_lag"] is None and all(b["mid_lag"] == a["mid_price"] and b["k_turn"] == b["macd_dif"] * 2 for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_kernels_are_audited(spark, bars, tmp_path):
    def make(fn, *columns):
        return [I.Kernel("user", ("close",), columns, fn)]

    with pytest.raises(ValueError, match="would replace"):
        I.indicator_table(bars, extra={}, kernels=make(lambda a: {"ma5": a["close"]}, "ma5"))
    with pytest.raises(ValueError, match="like a judgement"):
        I.indicator_table(bars, extra={}, kernels=make(lambda a: {"buy_x": a["close"]}, "buy_x"))
    for broken, message in ((lambda a: {"x": a["close"][1:]}, "has shape"), (lambda a: {"x": a["close"] / 0.0}, "infinite"), (lambda a: {"y": a["close"]}, "returned")):
        with pytest.raises(Exception, match=message):
            I.indicator_table(bars, extra={}, kernels=make(broken, "x")).collect()
    path = str(tmp_path / "i")
    sinks.write_indicators(I.indicator_table(bars, extra={}, kernels=make(lambda a: {"x": a["close"]}, "x")), path, ["x"])
    with pytest.raises(ValueError, match="without a value"):
        sinks.write_indicators(I.indicator_table(bars, extra={}, kernels=make(lambda a: {"x": a["close"] * np.nan}, "x")), path, ["x"])
    assert releases.current(spark, path).number == 1 and releases.read(spark, path, "indicators").where("x = close").count() == bars.count()
    changed = make(lambda a: (a["close"].fill(0.0), {"x": a["close"]})[1], "x")
    assert I.indicator_table(bars, extra={}, kernels=changed).where("close = 0").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_what_is_asked_goes_through_the_pass(spark, bars):
    pool = P.build_pool(bars, ST.B1_V0, validate=False)
    assert "lead(" in plan_of(pool.select("symbol", "t20_close"))
    narrow = plan_of(pool.select("symbol", "date"))
    assert "lead(" not in narrow and "60 PRECEDING" not in narrow and "59 PRECEDING" not in narrow
    # Marks written as text are looked at twice; the pool behind them is built once.
    assert "FlatMapGroupsInArrow" not in plan_of(C.selected_rows(pool.withColumn("selected", F.lit("1"))))


def test_a_step_reads_the_new_value_of_a_column_the_bars_have_too(bars):
    copy = Kernel("copy", ("ma5",), ("ma5_seen",), lambda a: {"ma5_seen": a["ma5"]})
    block = I.Block(windows=I.average_needs((5,)), columns=I.moving_average_columns((5,))) + I.macd() + I.Block(steps=[copy])
    stale = bars.withColumn("ma5", F.lit(-1.0)).withColumn("macd_dif", F.lit(-2.0))
    out = I.run(stale, block)
    assert out.columns == [*bars.columns, "ma5", "macd_dif", "macd_dea", "macd_hist", "ma5_seen"]
    got, plain = by_hand(out), by_hand(I.run(bars, block))
    close_to(got.ma5_seen, plain.ma5)
    close_to(got.ma5, plain.ma5)
    close_to(got.macd_dif, plain.macd_dif)
