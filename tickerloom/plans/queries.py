"""Registered queries: each a pipeline over the given tables, with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import scalars as S
from tickerloom.functions.recursive import Kernel
from tickerloom.operators import alpha as A
from tickerloom.operators import cleaning as C
from tickerloom.operators import contract as CT
from tickerloom.operators import factors as FA
from tickerloom.operators import grid as G
from tickerloom.operators import indicators as I
from tickerloom.operators import labels as L
from tickerloom.operators import pool as P
from tickerloom.operators import reports as RP
from tickerloom.operators import strategies as ST
from tickerloom.plans import fixtures as X
from tickerloom.plans import oracle as O
from tickerloom.scratch import materialize, scratch_path
from tickerloom.sources import releases, sinks
from tickerloom.sources.tables import code_list, date_span, full_market, index_series
from tickerloom.streaming import events as EV

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Numeric columns of the stage-low pool whose names qualify as factors; which of them are factors is decided by their values.
CANDIDATES = [
    "prev_close", "prev_volume", "daily_return_pct", "intraday_return_pct", "amplitude_pct", "upper_shadow_pct", "lower_shadow_pct", "body_pct",
    "body_abs_pct", "is_red_k", "is_green_k", "is_flat_k", "volume_ratio_ma5", "volume_ratio_ma10", "volume_ratio_prev1", "macd_dif", "macd_dea",
    "macd_hist", "kdj_k", "kdj_d", "kdj_j", "previous_20d_low", "close_to_previous_20d_low_pct", "low_to_previous_20d_low_pct", "range_60d_high",
    "range_60d_low", "range_60d_pct", "close_position_60d_pct", "b1_tminus1_j", "renko_value", "close_to_ma20_pct", "close_to_ma60_pct", "b1_j_low",
    "b1_not_break_previous_20d_low", "is_uptrend_pullback", "is_range_low", "b1_stage_low_valid", "t0_close_to_z_short_trend_line_pct",
    "t0_close_to_z_long_trend_line_pct", "z_short_trend_above_z_long_trend_line", "t1_open_gap_pct",
]
TARGETS = ["fwd_return_pct_T1", "fwd_return_pct_T2"]
ALL_TARGETS = [f"fwd_return_pct_T{h}" for h in range(1, 21)]
REFRESH_FROM = "1999-01-01"
BUCKETS, LEAST, TOP_N, TRIALS, LEAST_IC = 10, 50, 5, 200, 10


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: X.tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --------------------------------------------------------------------------
# bars and indicators
# --------------------------------------------------------------------------

@query("bars_weekly", O.query(O.rounded("symbol date open~ high~ low~ close~ volume~ amount~", "bars")))
def bars_weekly(spark, sf):
    return C.clean_bars(X.bars(spark, sf)).select("symbol", "date", "open", "high", "low", "close", "volume", "amount")


@query("dedup_keep_last", O.query(
    "SELECT symbol, date, " + ", ".join(f"{O.r4(c)} AS {c}" for c in ("px", "q", "a"))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY k DESC) AS rn FROM trades) WHERE rn = 1"))
def dedup_keep_last(spark, sf):
    trades = X.trades(spark, sf)
    return C.keep_last(trades, ["symbol", "date"], ["k"]).select("symbol", "date", "px", "q", "a")


KLINE_OUT = "symbol date prev_close~ prev_volume~ daily_return_pct~ intraday_return_pct~ amplitude_pct~ body_pct~ body_abs_pct~ upper_shadow_pct~ lower_shadow_pct~ is_red_k is_green_k is_flat_k"


def names(spec: str) -> list[str]:
    return [n.rstrip("~#") for n in spec.split()]


@query("kline", O.query(O.rounded(KLINE_OUT, "kline"), O.KLINE))
def kline(spark, sf):
    return I.kline(X.bars(spark, sf)).select(*names(KLINE_OUT))


def facts(out: str, price: str = "wide") -> str:
    return O.query(O.rounded(out, "inputs"), O.KLINE, O.FACTS, O.INPUTS, price=price)


@query("ma", facts("symbol date ma5~ ma10~ ma20~ ma60~"))
def ma(spark, sf):
    return I.moving_averages(X.bars(spark, sf)).select("symbol", "date", "ma5", "ma10", "ma20", "ma60")


VOLUME_OUT = "symbol date volume_ratio_prev1~ volume_ma5~ volume_ratio_ma5~ volume_ma10~ volume_ratio_ma10~"


@query("volume_ratios", facts(VOLUME_OUT))
def volume_ratios(spark, sf):
    return I.volume_ratios(X.bars(spark, sf)).select(*names(VOLUME_OUT))


@query("macd", O.query(O.rounded("symbol date macd_dif~ macd_dea~ macd_hist~", "tab"), chain=True))
def macd(spark, sf):
    return I.run(X.bars(spark, sf), I.macd()).select("symbol", "date", "macd_dif", "macd_dea", "macd_hist")


@query("renko", O.query(O.rounded("symbol date renko_value~", "tab"), chain=True))
def renko(spark, sf):
    return I.run(X.bars(spark, sf), I.renko()).select("symbol", "date", "renko_value")


@query("z_trend", O.query(O.rounded("symbol date z_short_trend_line~ z_long_trend_line~", "tab"), chain=True))
def z_trend(spark, sf):
    return I.run(X.bars(spark, sf), I.z_trend()).select("symbol", "date", "z_short_trend_line", "z_long_trend_line")


@query("kdj_b1", O.query(O.rounded("symbol date kdj_k~ kdj_d~ kdj_j~", "tab"), chain=True))
def kdj_b1(spark, sf):
    return I.run(X.bars(spark, sf), I.kdj_loose()).select("symbol", "date", "kdj_k", "kdj_d", "kdj_j")


@query("kdj_b2", O.query(
    f"SELECT symbol, date, {O.r4('ks')} AS kdj_k, {O.r4('ds')} AS kdj_d, {O.r4('js')} AS kdj_j FROM tab", chain=True))
def kdj_b2(spark, sf):
    return I.run(X.bars(spark, sf), I.kdj_strict()).select("symbol", "date", "kdj_k", "kdj_d", "kdj_j")


SUPPORT_OUT = "symbol date previous_20d_low~ close_to_previous_20d_low_pct~ low_to_previous_20d_low_pct~ range_60d_high~ range_60d_low~ range_60d_pct~ close_position_60d_pct~"


@query("support_range", facts(SUPPORT_OUT))
def support_range(spark, sf):
    return I.support_and_range(X.bars(spark, sf)).select(*names(SUPPORT_OUT))


@query("downtrend20", facts("symbol date b1_structure_downtrend_20"))
def downtrend20(spark, sf):
    return I.downtrend(X.bars(spark, sf)).select("symbol", "date", "b1_structure_downtrend_20")


@query("low_volume_count", O.query(
    f"SELECT symbol, date, CASE WHEN bar >= 20 THEN {O.r4('(SELECT count(*) FROM bars p WHERE p.symbol = bars.symbol AND p.bar BETWEEN bars.bar - 19 AND bars.bar AND p.volume >= bars.volume)')} END AS low_volume_count FROM bars"))
def low_volume_count(spark, sf):
    return I.low_volume_count(X.bars(spark, sf)).select("symbol", "date", "low_volume_count")


TABLE_OUT = (
    "symbol file date open~ high~ low~ close~ volume~ amount~ daily_return_pct~ intraday_return_pct~ amplitude_pct~ upper_shadow_pct~"
    " lower_shadow_pct~ body_pct~ body_abs_pct~ is_red_k is_green_k is_flat_k ma5~ ma10~ ma20~ ma60~ volume_ratio_prev1~ volume_ma5~"
    " volume_ratio_ma5~ volume_ma10~ volume_ratio_ma10~ macd_dif~ macd_dea~ macd_hist~ renko_value~ prev_close~ prev_volume~"
    " z_long_trend_line~ z_short_trend_line~")


@query("indicator_table", O.query(O.rounded(TABLE_OUT, "tab"), chain=True, price="narrow"))
def indicator_table(spark, sf):
    return I.indicator_table(X.bars(spark, sf, "narrow"), extra={}).select(*names(TABLE_OUT))


@query("indicator_store", O.query(O.rounded(TABLE_OUT, "tab"), chain=True, price="narrow"))
def indicator_store(spark, sf):
    """Bars stored once in buckets of symbols; the indicators over them need no exchange and are stored as a release."""
    stored = sinks.save_by_symbol(X.bars(spark, sf, "narrow"), f"bar_store_{uuid.uuid4().hex}", buckets=8)
    table = I.indicator_table(stored, extra={}, bucketed=True)
    path = scratch_path(spark, "indicator-store")
    sinks.write_indicators(table, path, ma_windows=list(I.MA_WINDOWS))
    return releases.read(spark, path, "indicators").select(*names(TABLE_OUT))


@query("indicator_resume", O.query(O.rounded(TABLE_OUT, "tab"), chain=True, price="narrow"))
def indicator_resume(spark, sf):
    """The table in three steps of time, each from the state the one before left."""
    bars = materialize(X.bars(spark, sf, "narrow"), "bars")
    cuts = ["0001-01-01", "1995-06-30", "1998-03-02", "9999-12-31"]
    state, parts = None, []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows, state = I.resume_indicators(state, bars.where(f"date > DATE '{low}' AND date <= DATE '{high}'"))
        parts.append(rows.select(*names(TABLE_OUT)))
    return parts[0].union(parts[1]).union(parts[2])


def _streak(a: dict) -> dict:
    up = np.diff(a["close"], prepend=np.nan) > 0
    place = np.arange(len(up))
    return {"up_streak": place - np.maximum.accumulate(np.where(up, -1, place))}


def _drawdown(a: dict) -> dict:
    return {"drawdown_pct": (a["close"] / np.maximum.accumulate(a["close"]) - 1.0) * 100.0}


def _macd_swing(a: dict) -> dict:
    return {"macd_turn": np.concatenate(([np.nan], np.diff(a["macd_hist"])))[:len(a["macd_hist"])]}


KERNELS = [
    Kernel("streak", ("close",), ("up_streak",), _streak), Kernel("drawdown", ("close",), ("drawdown_pct",), _drawdown),
    Kernel("swing", ("macd_hist",), ("macd_turn",), _macd_swing),
]


@query("user_kernels", O.query(
    f"SELECT symbol, date, {O.r4('up_streak')} AS up_streak, {O.r4('drawdown_pct')} AS drawdown_pct, {O.r4('macd_turn')} AS macd_turn FROM k2",
    f"k1 AS (SELECT *, CAST(bar - max(CASE WHEN up THEN -1 ELSE bar END) OVER ({O.BY}) AS DOUBLE) AS up_streak FROM (SELECT *, coalesce(close > lag(close) OVER ({O.BY}), false) AS up FROM tab)),"
    f"k2 AS (SELECT *, {O.chg('close', f'max(close) OVER ({O.BY})')} AS drawdown_pct, macd_hist - lag(macd_hist) OVER ({O.BY}) AS macd_turn FROM k1)", chain=True, price="narrow"))
def user_kernels(spark, sf):
    """Three user indicators inside the pass over each symbol, written and audited in one job."""
    path, added = scratch_path(spark, "user-indicators"), [c for k in KERNELS for c in k.columns]
    sinks.write_indicators(I.indicator_table(X.bars(spark, sf, "narrow"), extra={}, kernels=KERNELS), path, added)
    return releases.read(spark, path, "indicators").select("symbol", "date", *added)


EVENT_BARS = """
WITH e AS (SELECT event_id, ts, event_type, value, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) // 7 AS w FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
f AS (SELECT *, least(w + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END, (SELECT max(w) + 1 FROM e)) AS k FROM e),
l AS (SELECT * FROM f UNION ALL SELECT * REPLACE (least(k + 1, (SELECT max(w) + 1 FROM e)) AS k) FROM f WHERE event_id % 50 = 0),
m AS (SELECT k, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 6 HOUR AS mark FROM l GROUP BY k),
once AS (SELECT DISTINCT event_id, ts, event_type, value FROM l JOIN m USING (k) WHERE mark IS NULL OR ts > mark),
b AS (SELECT event_type, date_trunc('hour', ts) AS s, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, sum(value) AS volume, count(*) AS events FROM once GROUP BY 1, 2)
"""


@query("event_bars", EVENT_BARS + "SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS start, " + ", ".join(f"{O.r4(c)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
       + ", events FROM b WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM l) - INTERVAL 6 HOUR")
def event_bars(spark, sf):
    """Hourly bars of an event stream that lands by weeks; some events land two weeks late, some land twice."""
    known = X.table(spark, sf, "events").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "CAST(value AS double) AS value")
    first, latest = known.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    if first is None:
        return EV.windowed_bars(known).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
    weeks = known.withColumn("w", F.floor(F.date_diff("ts", F.lit(first)) / 7))
    last = (latest - first).days // 7
    landed = weeks.withColumn("k", F.least(F.col("w") + F.when(F.col("event_id") % 97 == 0, 2).otherwise(0), F.lit(last + 1)))
    again = landed.where("event_id % 50 = 0").withColumn("k", F.least(F.col("k") + 1, F.lit(last + 1)))
    landed = materialize(landed.union(again).drop("w"), "landings")
    folder = scratch_path(spark, "event-stream")
    for k in range(last + 2):
        landed.where(F.col("k") == k).drop("k").write.mode("append").parquet(f"{folder}/in")
        EV.take_landed(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


# --------------------------------------------------------------------------
# labels and pools
# --------------------------------------------------------------------------

@query("forward_labels", O.query(O.rounded(
    "symbol date " + " ".join(f"t{h}_date t{h}_open~ t{h}_close~ fwd_return_pct_T{h}~ fwd_up_T{h}" for h in range(1, 21)), "lab"), labels=True))
def forward_labels(spark, sf):
    return L.forward_labels(X.bars(spark, sf)).select("symbol", "date", *[c for c in L.forward_columns() if c != "forward_data_status"])


@query("forward_status", O.query("SELECT symbol, date, forward_data_status FROM lab", labels=True))
def forward_status(spark, sf):
    return L.forward_labels(X.bars(spark, sf)).select("symbol", "date", "forward_data_status")


@query("market_labels", O.query(
    f"SELECT symbol, date, {O.r4('t1_open')} AS t1_open, {O.r4('t2_close')} AS t2_close, {O.r4('t3_close')} AS t3_close, {O.r4(O.chg('t2_close', 't1_open'))} AS t2_return_pct, {O.r4(O.chg('t3_close', 't1_open'))} AS t3_return_pct FROM lab WHERE t1_open IS NOT NULL", labels=True))
def market_labels(spark, sf):
    return L.market_labels(X.bars(spark, sf))


POOL_OUT = (
    "symbol file date selection_strategy open~ high~ low~ close~ volume~ amount~ prev_close~ prev_volume~ daily_return_pct~ amplitude_pct~"
    " upper_shadow_pct~ ma5~ ma20~ ma60~ volume_ratio_ma5~ volume_ratio_ma10~ volume_ratio_prev1~ macd_dif~ macd_dea~ macd_hist~ kdj_k~ kdj_d~ kdj_j~"
    " renko_value~ previous_20d_low~ close_to_previous_20d_low_pct~ low_to_previous_20d_low_pct~ close_to_ma20_pct~ close_to_ma60_pct~ range_60d_high~"
    " range_60d_low~ range_60d_pct~ close_position_60d_pct~ b1_j_low b1_tminus1_j~ b1_not_break_previous_20d_low is_uptrend_pullback is_range_low"
    " b1_stage_low_valid t0_close_to_z_short_trend_line_pct~ t0_close_to_z_long_trend_line_pct~ z_short_trend_above_z_long_trend_line"
    " t1_date t1_open~ t1_close~ t20_date t20_open~ t20_close~ fwd_return_pct_T1~ fwd_return_pct_T5~ fwd_return_pct_T20~ fwd_up_T1 fwd_up_T20 forward_data_status")


def stored_bars(spark, sf, price="narrow") -> DataFrame:
    """Bars made of the trades once, for queries that read them more than once."""
    return materialize(X.bars(spark, sf, price), "bars")


def b1_pool(spark, sf, name=ST.B1_V0, price="narrow", validate=False, bars=None) -> DataFrame:
    """A pool; with ``validate`` stored, and checked against its contract while it is stored."""
    return P.build_pool(X.bars(spark, sf, price) if bars is None else bars, name, validate=validate)


@query("b1_v0_pool", O.pool_query(O.rounded(POOL_OUT, "b1v0")))
def b1_v0_pool(spark, sf):
    return b1_pool(spark, sf, validate=True).select(*names(POOL_OUT))


@query("pool_dirty_bars", O.pool_query(O.rounded(POOL_OUT, "b1v0")))
def pool_dirty_bars(spark, sf):
    """Exchange-qualified symbols, older duplicates and rows without a price give the clean pool."""
    bars = stored_bars(spark, sf).withColumn("age", F.lit(1))
    older = bars.withColumns({"close": F.col("close") * 2.0, "age": F.lit(0)})
    broken = bars.withColumns({"close": F.lit(None).cast("double"), "age": F.lit(2)})
    dirty = bars.unionByName(older).unionByName(broken).withColumn("symbol", F.concat(F.lit("SH#"), "symbol"))
    return P.build_pool(dirty, ST.B1_V0, order=["age"]).select(*names(POOL_OUT))


@query("b1_v1_pool", O.pool_query(O.rounded(POOL_OUT + " b1_structure_downtrend_20", "b1v1"), price="wide"))
def b1_v1_pool(spark, sf):
    return b1_pool(spark, sf, ST.B1_V1, "wide", validate=True).select(*names(POOL_OUT), "b1_structure_downtrend_20")


CONFIRM_MAP = {
    "b1_tdx_range_high_20": "rh20", "b1_tdx_range_low_20": "rl20", "b1_tdx_range_width_20": "rw20", "b1_tdx_position_20": "pos20",
    "b1_tdx_previous_20d_low": "pnlow", "b1_tdx_close_to_previous_20d_low": "dplow", "b1_tdx_bbi": "bbi", "b1_tdx_zsl_ema21": "zsl",
    "b1_tdx_distance_to_ma20": "dma20", "b1_tdx_distance_to_bbi": "dbbi", "b1_tdx_distance_to_zsl": "dzsl",
    "b1_tdx_low_volume_count_20": "lowvc", "b2_tdx_upper_shadow_ratio": "upsh", "ma5": "ma5", "ma60": "ma60", "volume_ma10": "volume_ma10",
    "volume_ratio_ma5": "volume_ratio_ma5", "kdj_k": "kdj_k", "kdj_d": "kdj_d", "kdj_j": "kdj_j", "macd_hist": "macd_hist", "daily_return_pct": "daily_return_pct",
    "fwd_return_pct_T1": "fwd_return_pct_T1", "fwd_return_pct_T20": "fwd_return_pct_T20",
}
CONFIRM_SQL = (
    "SELECT symbol, date, 'b2_confirm_tdx_b1_v0' AS selection_strategy, b1_date, CAST(bar - sig_bar AS BIGINT) AS b1_lag_trade_days, CAST(sig AS BIGINT) AS b1_tdx_signal, "
    + ", ".join(f"{O.r4(v)} AS {k}" for k, v in CONFIRM_MAP.items())
    + " FROM cf3 JOIN lab USING (symbol, date) WHERE recent AND daily_return_pct > 4 AND close > open AND volume > prev_volume AND kdj_j < 55 AND upsh <= 0.25"
)


@query("b2_tdx_pool", O.query(CONFIRM_SQL, O.CONFIRM, chain=True, labels=True))
def b2_tdx_pool(spark, sf):
    pool = P.build_pool(X.bars(spark, sf), ST.B2_INLINE)
    return pool.select("symbol", "date", "selection_strategy", "b1_date", "b1_lag_trade_days", "b1_tdx_signal", *CONFIRM_MAP)


@query("entry_gap", O.pool_query(f"SELECT symbol, date, CASE WHEN close > 0 THEN {O.r4(O.chg('t1_open', 'close'))} END AS t1_open_gap_pct FROM b1v0"))
def entry_gap(spark, sf):
    return P.entry_gap(b1_pool(spark, sf)).select("symbol", "date", "t1_open_gap_pct")


@query("rehydrate", O.pool_query(O.rounded("symbol date ma5~ ma20~ volume_ratio_ma5~", "b1v0")))
def rehydrate(spark, sf):
    """Columns that a pool has dropped come back from the indicator table."""
    bars = stored_bars(spark, sf)
    pool = b1_pool(spark, sf, bars=bars).select("symbol", "date")
    table = I.indicator_table(bars, extra={})
    return P.rehydrate(pool, table, ["ma5", "ma20", "volume_ratio_ma5"])


@query("fill_missing_kline", O.query(O.rounded("symbol date amplitude_pct~ body_pct~ is_red_k is_green_k is_flat_k ma5~ volume_ratio_prev1~", "tab"), chain=True, price="narrow"))
def fill_missing_kline(spark, sf):
    """A cache without most candle columns and with wrong colours gets both right."""
    table = I.indicator_table(X.bars(spark, sf, "narrow"), extra={}).withColumn("is_red_k", F.lit(7))
    stale = table.select("symbol", "file", "date", "open", "high", "low", "close", "volume", "amount", "ma5", "is_red_k", "amplitude_pct")
    out = I.fill_missing_kline(stale)
    return out.select("symbol", "date", "amplitude_pct", "body_pct", "is_red_k", "is_green_k", "is_flat_k", "ma5", "volume_ratio_prev1")


@query("canonical_kline", O.query(O.rounded("symbol date amplitude_pct~ body_pct~ upper_shadow_pct~ volume_ratio_prev1~", "tab"), chain=True, price="narrow"))
def canonical_kline(spark, sf):
    """Wrong candle columns are computed anew."""
    stale = X.bars(spark, sf, "narrow").withColumns({"amplitude_pct": F.lit(-1.0), "body_pct": F.lit(-1.0)})
    return I.canonical_kline(stale).select("symbol", "date", "amplitude_pct", "body_pct", "upper_shadow_pct", "volume_ratio_prev1")


@query("selected_rows", O.pool_query("SELECT symbol, date FROM b1v0 WHERE day(date) % 3 = 1"))
def selected_rows(spark, sf):
    pool = b1_pool(spark, sf).select("symbol", "date", F.expr("CAST(day(date) % 3 AS STRING)").alias("selected"))
    return C.selected_rows(pool).select("symbol", "date")


@query("pool_contract", O.pool_query("SELECT count(*) AS row_count, 1 AS has_factors FROM b1v0"))
def pool_contract(spark, sf):
    report = CT.validate_pool(b1_pool(spark, sf), ST.B1_V0)
    return spark.createDataFrame([(report.row_count, int("kdj_j" in report.factor_columns))], "row_count long, has_factors int")


@query("build_window", O.pool_query(
    "SELECT max(date) - 45 AS first_day, (SELECT max(date) FROM bars) AS last_day, count(*) AS old_rows FROM b1v0"))
def build_window(spark, sf):
    bars = stored_bars(spark, sf)
    window = P.resolve_window(bars, materialize(b1_pool(spark, sf, bars=bars).select("symbol", "date"), "pool"), incremental=True)
    return spark.createDataFrame([(window.start, window.end, window.old_pool_rows)], "first_day date, last_day date, old_rows long")


@query("stored_window", O.pool_query(
    "SELECT 'incremental_refresh_window' AS mode, max(date) - 45 AS first_day, (SELECT max(date) FROM bars) AS last_day, (SELECT min(date) FROM bars) AS market_min, min(date) AS old_min, max(date) AS old_max, count(*) AS old_rows,"
    " (SELECT count(DISTINCT date) FROM bars WHERE date >= (SELECT max(date) - 45 FROM b1v0)) AS trading_dates FROM b1v0"))
def stored_window(spark, sf):
    """The build window of a stored pool over stored bars, from the footers of both."""
    root = scratch_path(spark, "stored-window")
    bars = stored_bars(spark, sf)
    sinks.write_bars(bars, f"{root}/bars")
    sinks.write_pool(b1_pool(spark, sf, bars=bars), f"{root}/pool", ST.B1_V0)
    parts = releases.current(spark, f"{root}/pool").tables["pool"].parts.values()
    w = P.resolve_window(
        spark.read.parquet(f"{root}/bars"), incremental=True, market=date_span(spark, f"{root}/bars"),
        old=date_span(spark, *[f"{root}/pool/{p}" for p in parts]))
    return spark.createDataFrame(
        [(w.mode, w.start, w.end, w.market_min, w.old_pool_min, w.old_pool_max, w.old_pool_rows, w.trading_dates)],
        "mode string, first_day date, last_day date, market_min date, old_min date, old_max date, old_rows long, trading_dates long")


@query("merge_report", O.pool_query(
    f"SELECT 'incremental_merge' AS mode, CAST('{REFRESH_FROM}' AS DATE) AS replace_start, DATE '2100-01-01' AS replace_end, count(*) FILTER (WHERE date <= DATE '2000-06-05') AS old_rows,"
    f" count(*) FILTER (WHERE date BETWEEN DATE '{REFRESH_FROM}' AND DATE '2000-06-05') AS removed_old_rows, count(*) FILTER (WHERE date >= DATE '{REFRESH_FROM}') AS new_rows, 0 AS dropped_duplicate_rows, count(*) AS final_rows FROM b1v0"))
def merge_report(spark, sf):
    bars = stored_bars(spark, sf)
    old = materialize(P.build_pool(bars, ST.B1_V0, end_date="2000-06-05", validate=False), "old")
    new = materialize(P.build_pool(bars, ST.B1_V0, start_date=REFRESH_FROM, validate=False), "new")
    return P.merge_report(old, new, P.merge_window(old, new, REFRESH_FROM, "2100-01-01"), REFRESH_FROM, "2100-01-01")


@query("pool_release", O.pool_query(
    "SELECT symbol, date, forward_data_status FROM b1v0 WHERE strftime(date, '%Y-%m') <> '1996-06'"))
def pool_release(spark, sf):
    """A stored pool whose window is refreshed without the rows of one month, which are gone afterwards."""
    bars = stored_bars(spark, sf)
    pool, path = b1_pool(spark, sf, validate=True, bars=bars), scratch_path(spark, "pool-release")
    sinks.write_pool(pool, path, ST.B1_V0)
    window = P.resolve_window(bars, start_date="1996-05-15", end_date=pool.agg(F.max("date")).first()[0], incremental=True)
    sinks.refresh_pool(pool.where("date >= '1996-05-15' AND date_format(date, 'yyyy-MM') <> '1996-06'"), path, ST.B1_V0, window)
    return sinks.read_pool(spark, path).select("symbol", "date", "forward_data_status")


@query("schema_normalize", O.pool_query(O.rounded("symbol date body_pct~ volume~ kdj_j~", "b1v0")))
def schema_normalize(spark, sf):
    """Versioned columns fill the gaps of plain ones, numbers come back from text, scores and codes with exchanges go."""
    pool = b1_pool(spark, sf).select("symbol", "date", "selection_strategy", "is_red_k", "body_pct", "volume", "kdj_j")
    old = pool.withColumns({
        "b2v1_body_pct": F.col("body_pct"), "body_pct": F.when(F.col("is_red_k") == 0, F.col("body_pct")), "b2v3_kdj_j": F.col("kdj_j"),
        "volume": F.col("volume").cast("string"), "b2v2_score_total": F.lit(1.0), "score": F.lit(3), "symbol": F.concat(F.lit("SZ#"), "symbol"),
        "date": F.col("date").cast("string")}).drop("kdj_j")
    out = P.normalize_schema(old)
    if set(out.columns) != {"symbol", "date", "selection_strategy", "is_red_k", "body_pct", "volume", "kdj_j"}:
        raise ValueError(f"columns after normalising: {out.columns}")
    return out.select("symbol", "date", "body_pct", "volume", "kdj_j")


@query("pool_view", O.pool_query(
    f"SELECT row_number() OVER (ORDER BY volume DESC, date, symbol) AS place, symbol, date, {O.r4('volume')} AS volume, {O.r4('kdj_j')} AS kdj_j FROM b1v0 WHERE contains(symbol, '60') AND forward_data_status = 'ok' QUALIFY place <= 200"))
def pool_view(spark, sf):
    """The first 200 rows of a pool page: symbols with 60, complete labels, most volume first, in that order."""
    page = C.view(b1_pool(spark, sf), symbol_contains="60", label=("forward_data_status", "ok"), sort_by="volume", columns=["symbol", "date", "volume", "kdj_j"])
    return page.limit(200).withColumn("place", F.monotonically_increasing_id() + 1)


@query("recent_days", O.pool_query("SELECT row_number() OVER (ORDER BY date DESC) AS place, date, count(*) AS pool_count FROM b1v0 GROUP BY date QUALIFY place <= 30"))
def recent_days(spark, sf):
    return P.daily_counts(b1_pool(spark, sf).select("date"), last=30).withColumn("place", F.monotonically_increasing_id() + 1)


VIEWED = [*(c for c in CANDIDATES if c != "t1_open_gap_pct"), "ma5", "ma10", "ma20", "ma60", "volume_ma5", "volume_ma10", *(f"t{h}_{c}" for h in range(5, 21) for c in ("open", "close"))]


@query("factor_kinds", O.pool_query(
    "SELECT c.name AS factor, CASE WHEN count(c.x) FILTER (WHERE c.x IN (0, 1)) > 0 AND count(c.x) FILTER (WHERE c.x IN (0, 1)) >= greatest(1, floor(count(c.x) * 0.9)) THEN 'boolean' ELSE 'numeric' END AS kind FROM (SELECT unnest(["
    + ", ".join(f"{{'name': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in VIEWED) + "]) AS c FROM b1v0) GROUP BY 1 HAVING count(c.x) > 0"))
def factor_kinds(spark, sf):
    """Which columns of the pool the single-factor view treats as flags and which as numbers."""
    return spark.createDataFrame(list(FA.factor_kinds(b1_pool(spark, sf, validate=True)).items()), "factor string, kind string")


@query("strategy_rows", O.pool_query(
    f"SELECT '{ST.B1_V0}' AS strategy, count(*) AS rows FROM b1v0 UNION ALL SELECT '{ST.B1_V1}', count(*) FROM b1v1 UNION ALL SELECT '{ST.B2_INLINE}', count(*) FROM ({ORACLES['b2_tdx_pool']})", price="wide"))
def strategy_rows(spark, sf):
    """Every registered rule that needs nothing but bars, by its name."""
    bars, out = stored_bars(spark, sf, "wide"), None
    for name in ST.strategy_names():
        if name != ST.B2_FROM_B1:
            rows = P.build_pool(bars, name, validate=False).groupBy(F.lit(name).alias("strategy")).agg(F.count(F.lit(1)).alias("rows"))
            out = rows if out is None else out.union(rows)
    return out


@query("formal_pools", O.pool_query("SELECT date, symbol, 'b1_v0' AS formal_pool_name FROM b1v0 UNION SELECT date, symbol, 'b1_v1' FROM b1v1 WHERE day(date) % 2 = 0", price="wide"))
def formal_pools(spark, sf):
    """Two pools, one with exchange codes, a selection mark and repeated rows."""
    bars = stored_bars(spark, sf, "wide")
    first = b1_pool(spark, sf, ST.B1_V0, bars=bars).select("symbol", "date")
    second = b1_pool(spark, sf, ST.B1_V1, bars=bars).select(F.concat(F.lit("SH#"), "symbol").alias("code"), "date", F.expr("1 - day(date) % 2 AS selected"))
    return A.formal_union({"b1_v0_pool": first, "b1_v1_pool": second.union(second)})


@query("file_codes", """
WITH n AS (SELECT c_custkey, c_custkey % 5 AS kind, lpad(CAST(c_custkey AS VARCHAR), 3, '0') AS tail, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer)
SELECT c_custkey, CASE kind WHEN 0 THEN 'SH#600' || right(tail, 3) WHEN 1 THEN 'SZ#000' || right(tail, 3) WHEN 2 THEN '430' || right(tail, 3) WHEN 3 THEN 'BJ#830' || right(tail, 3) END AS exchange,
  CASE kind WHEN 4 THEN right(digits, 6) ELSE CASE kind WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '430' ELSE '830' END || right(tail, 3) END AS code FROM n""")
def file_codes(spark, sf):
    """Exchange symbols and codes from file names of five kinds."""
    tail = "right(lpad(CAST(c_custkey AS STRING), greatest(3, length(CAST(c_custkey AS STRING))), '0'), 3)"
    names_ = X.table(spark, sf, "customer").select("c_custkey", F.expr(
        f"CASE c_custkey % 5 WHEN 0 THEN concat('daily/sh#600', {tail}, '.txt') WHEN 1 THEN concat('000', {tail}, '.TXT') WHEN 2 THEN concat('a/b/430', {tail}, '.csv') WHEN 3 THEN concat('BJ#x830', {tail}, '.txt') ELSE concat('no code ', c_name) END AS name"))
    part = F.when(F.col("c_custkey") % 5 == 4, F.col("name")).otherwise(F.regexp_replace(F.element_at(F.split("name", "/"), -1), "#x?", "."))
    return names_.select("c_custkey", F.when(F.col("c_custkey") % 5 != 4, S.exchange_symbol("name")).alias("exchange"), S.code_in_parts(part).alias("code"))


@query("text_values", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS compact, CAST(o_orderdate AS DATE) AS day_first,
  floor(o_totalprice) AS price, o_orderstatus = 'F' AS done, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code FROM orders""")
def text_values(spark, sf):
    """Dates, grouped numbers, truth words and codes written as text and read again."""
    orders = X.table(spark, sf, "orders")
    text = orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/M/d").alias("a"), F.date_format("o_orderdate", "yyyyMMdd").alias("b"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("c"), F.format_number(F.floor("o_totalprice"), 0).alias("p"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("false").alias("f"), F.concat(F.lit("SH#"), F.col("o_custkey").cast("string")).alias("s"))
    return text.select(
        "o_orderkey", S.parse_date("a").alias("iso"), S.parse_date("b").alias("compact"), S.parse_date_day_first("c").alias("day_first"),
        S.parse_number("p").alias("price"), S.parse_boolean("f").alias("done"), S.normalize_symbol("s").alias("code"))


FROM_POOL_OUT = "symbol date b1_date daily_return_pct~ volume_ratio_prev1~ volume_ratio_ma5~ kdj_k~ kdj_d~ kdj_j~ upper_shadow_pct~ t1_high~ t1_low~ t20_high~ fwd_return_pct_T1~ fwd_return_pct_T20~"
FROM_POOL_FLAGS = {
    "b1_lag_trade_days": "CAST(bar - b1_bar AS BIGINT)", "b2_no_long_upper_shadow": O.bit("upper_shadow_pct <= 2"),
    "b2_near_limit_up": O.bit("daily_return_pct >= 9"), "b2_mid_large_positive": O.bit("daily_return_pct >= 6"),
    "b2_close_position_pct": O.r4(O.div("close - low", "high - low") + " * 100.0"),
    "forward_data_status": "CASE WHEN t1_open IS NULL THEN 'missing_t1' ELSE 'ok' END",
}


@query("b2_from_b1_pool", O.pool_query(
    O.rounded(FROM_POOL_OUT, "fp JOIN lab USING (symbol, date)").replace(" FROM fp", ", " + ", ".join(f"{v} AS {k}" for k, v in FROM_POOL_FLAGS.items()) + " FROM fp")
    + " WHERE bar - b1_bar BETWEEN 1 AND 5 AND daily_return_pct > 4 AND volume_ratio_prev1 > 1 AND kdj_j < 55", O.FROM_POOL, price="wide"))
def b2_from_b1_pool(spark, sf):
    bars = stored_bars(spark, sf, "wide")
    b1 = b1_pool(spark, sf, ST.B1_V1, bars=bars).select("symbol", "date")
    pool = P.build_pool(bars, ST.B2_FROM_B1, b1_pool=b1, with_range=True)
    return pool.select(*names(FROM_POOL_OUT), *FROM_POOL_FLAGS)




@query("incremental_merge", O.pool_query(O.rounded("symbol date selection_strategy close~ kdj_j~ fwd_return_pct_T20~ forward_data_status", "b1v0")))
def incremental_merge(spark, sf):
    """A refreshed window over an older build gives the full build again."""
    bars = stored_bars(spark, sf)
    old = P.build_pool(bars, ST.B1_V0, end_date="2000-06-05", validate=False)
    new = P.build_pool(bars, ST.B1_V0, start_date=REFRESH_FROM, validate=False)
    cols = ["symbol", "date", "selection_strategy", "close", "kdj_j", "fwd_return_pct_T20", "forward_data_status"]
    return P.merge_window(old.select(*cols), new.select(*cols), REFRESH_FROM, "2100-01-01")


DOWN40 = (
    "d40 AS (SELECT symbol, date, " + O.bit(
        f"({O.roll('max', 'high', 40)}) < ({O.roll('max', 'high', 40, 40, 40)}) * 0.99 AND ({O.roll('min', 'low', 40)}) < ({O.roll('min', 'low', 40, 40, 40)}) * 0.97")
    + " AS b1_structure_downtrend_40 FROM bars)")


@query("enrich_downtrend", O.pool_query("SELECT symbol, date, coalesce(b1_structure_downtrend_40, 0) AS b1_structure_downtrend_40 FROM b1v0 LEFT JOIN d40 USING (symbol, date)", DOWN40, price="wide"))
def enrich_downtrend(spark, sf):
    bars = stored_bars(spark, sf, "wide")
    pool = b1_pool(spark, sf, ST.B1_V0, bars=bars).select("symbol", "date")
    return P.enrich_downtrend(pool, bars).select("symbol", "date", "b1_structure_downtrend_40")


@query("calendar", O.query("SELECT DISTINCT date FROM bars"))
def calendar(spark, sf):
    return P.calendar(X.bars(spark, sf))


@query("pool_summary", O.pool_query("SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates, min(date) AS date_min, max(date) AS date_max FROM b1v0"))
def pool_summary(spark, sf):
    return P.pool_summary(b1_pool(spark, sf))


DESCRIBE = " UNION ALL ".join(
    f"SELECT '{t}' AS target_col, count({t}) AS count, {O.r4(f'avg({t})')} AS mean, {O.r4(f'stddev_samp({t})')} AS std, {O.r4(f'min({t})')} AS min, {O.r4(f'max({t})')} AS max,"
    f" {O.r4(f'avg(CASE WHEN {t} > 0 THEN 1.0 WHEN {t} <= 0 THEN 0.0 END)')} AS up_ratio,"
    f" {O.r4(f'quantile_cont({t}, 0.25)')} AS p25, {O.r4(f'quantile_cont({t}, 0.5)')} AS p50, {O.r4(f'quantile_cont({t}, 0.75)')} AS p75 FROM b1v0"
    for t in ALL_TARGETS)


@query("describe_returns", O.pool_query(DESCRIBE))
def describe_returns(spark, sf):
    return P.describe_returns(materialize(b1_pool(spark, sf).select(*ALL_TARGETS), "targets"), ALL_TARGETS)


@query("status_counts", O.pool_query("SELECT forward_data_status, count(*) AS rows FROM b1v0 GROUP BY 1"))
def status_counts(spark, sf):
    return P.status_counts(b1_pool(spark, sf))


@query("daily_pool_count", O.pool_query(
    f"SELECT d.date, pool_count, {O.r4('index_close')} AS index_close, {O.r4('index_return_pct')} AS index_return_pct FROM (SELECT date, count(*) AS pool_count FROM b1v0 GROUP BY date) d LEFT JOIN ix USING (date)",
    f"ix AS (SELECT date, c AS index_close, {O.chg('c', 'lag(c) OVER (ORDER BY date)')} AS index_return_pct FROM (SELECT date, avg(close) AS c FROM bars GROUP BY date))", price="wide"))
def daily_pool_count(spark, sf):
    bars = stored_bars(spark, sf, "wide")
    return P.daily_with_index(b1_pool(spark, sf, ST.B1_V0, bars=bars), index_series(X.index_bars(bars)))


CURVE = " UNION ALL ".join(
    f"SELECT {h} AS horizon, 'fwd_return_pct_T{h}' AS target_col, count(y) AS sample_count, {O.r4('avg(y)')} AS mean_return, {O.r4('median(y)')} AS median_return,"
    f" {O.r4('quantile_cont(y, 0.25)')} AS p25_return, {O.r4('quantile_cont(y, 0.75)')} AS p75_return, {O.r4('avg(CASE WHEN y > 0 THEN 1.0 WHEN y <= 0 THEN 0.0 END)')} AS up_ratio"
    f" FROM (SELECT fwd_return_pct_T{h} AS y FROM b1v0)" for h in range(1, 21))


@query("forward_curve", O.pool_query(CURVE))
def forward_curve(spark, sf):
    return RP.forward_curve(materialize(b1_pool(spark, sf).select(*ALL_TARGETS), "targets"), ALL_TARGETS)


# --------------------------------------------------------------------------
# factor analysis
# --------------------------------------------------------------------------

def analysis_pool(spark, sf) -> DataFrame:
    """The whole stage-low pool with its entry gap, stored."""
    return P.entry_gap(b1_pool(spark, sf, validate=True))


def factor_rows(spark, sf, keep: list[str]) -> DataFrame:
    """All detected factors against T+1 and T+2, row by row."""
    pool = analysis_pool(spark, sf)
    return FA.factor_target_rows(pool, FA.factor_columns(pool, ALL_TARGETS), TARGETS, keep)


@query("qcut_buckets", O.analysis(O.rounded("factor target_col symbol date x~ y~ bucket", "bucketed"), CANDIDATES, TARGETS, BUCKETS, LEAST))
def qcut_buckets(spark, sf):
    rows = factor_rows(spark, sf, ["symbol", "date"])
    return FA.value_buckets(rows, FA.KEYS, BUCKETS, LEAST).select("factor", "target_col", "symbol", "date", "x", "y", "bucket")


@query("rank_buckets", O.pool_query(
    f"SELECT factor, target_col, symbol, date, {O.r4('x')} AS x, {O.rank_bucket('no', 'n', '10')} AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY factor, target_col ORDER BY x, date, symbol) AS no, count(*) OVER (PARTITION BY factor, target_col) AS n FROM fr)",
    O.detected_rows(CANDIDATES, TARGETS)))
def rank_buckets(spark, sf):
    rows = factor_rows(spark, sf, ["symbol", "date"])
    return FA.rank_buckets(rows, FA.KEYS, BUCKETS, ["date", "symbol"]).select("factor", "target_col", "symbol", "date", "x", "bucket")


DETAIL_OUT = "factor target_col bucket sample_count min_factor~ max_factor~ mean_factor~ mean_return~ median_return~ up_ratio~ win_count loss_count"


@query("bucket_detail", O.analysis(O.rounded(DETAIL_OUT, "detail"), CANDIDATES, ALL_TARGETS, BUCKETS, LEAST))
def bucket_detail(spark, sf):
    return FA.analyze_direction(analysis_pool(spark, sf), ALL_TARGETS, None, BUCKETS, LEAST)[1]


@query("bucket_members", O.analysis(
    f"SELECT factor, target_col, symbol, date, bucket, {O.r4('x')} AS factor_value, {O.r4('y')} AS target_value FROM bucketed", CANDIDATES, TARGETS, BUCKETS, LEAST))
def bucket_members(spark, sf):
    pool = analysis_pool(spark, sf)
    out = FA.bucket_members(pool, FA.factor_columns(pool, ALL_TARGETS), TARGETS, BUCKETS, LEAST)
    return out.select("factor", "target_col", "symbol", "date", "bucket", "factor_value", "target_value")


@query("bucket_intervals", O.analysis(
    f"SELECT factor, target_col, bucket, sample_count, {O.r4('mean_return')} AS mean_return, printf('[%.2f, %.2f]', floor(min_factor * 100.0 + 0.5) / 100.0, floor(max_factor * 100.0 + 0.5) / 100.0) AS factor_interval FROM detail",
    CANDIDATES, TARGETS, BUCKETS, LEAST))
def bucket_intervals(spark, sf):
    detail = FA.bucket_detail(FA.value_buckets(factor_rows(spark, sf, []), FA.KEYS, BUCKETS, LEAST))
    return FA.interval_view(detail, 2).select("factor", "target_col", "bucket", "sample_count", "mean_return", "factor_interval")


@query("ic", O.pool_query(O.rounded("factor target_col n spearman_ic~ pearson_ic~", "ic"), O.detected_rows(CANDIDATES, ALL_TARGETS), O.IC))
def ic(spark, sf):
    pool = analysis_pool(spark, sf)
    return G.correlation_grid(pool, [], FA.factor_columns(pool, ALL_TARGETS), ALL_TARGETS)


SUMMARY_OUT = (
    "target_col schema_version factor bucket_pattern action_hint risk_side pattern_reason monotonic_bias monotonic_votes vote_spearman vote_pearson vote_tail_return"
    " vote_tail_up_ratio sample_count bucket_count_actual spearman_ic~ pearson_ic~ bottom_bucket top_bucket bottom_mean_return~"
    " middle_mean_return~ top_mean_return~ top_minus_bottom_return~ top_vs_middle_return~ bottom_vs_middle_return~ bottom_up_ratio~ middle_up_ratio~ top_up_ratio~"
    " top_minus_bottom_up_ratio~ top_vs_middle_up_ratio~ bottom_vs_middle_up_ratio~ best_bucket worst_bucket best_bucket_mean_return~ worst_bucket_mean_return~"
    " best_minus_worst_return~ best_bucket_up_ratio~ worst_bucket_up_ratio~ best_minus_worst_up_ratio~")


@query("direction_summary", O.analysis(
    f"SELECT *, '{FA.SCHEMA_VERSION}' AS schema_version FROM s7", CANDIDATES, ALL_TARGETS, BUCKETS, LEAST, O.IC, O.SHAPE,
    O.described(FA.SHAPES, FA.PATTERN_ORDER, SUMMARY_OUT.replace(" schema_version", ""))))
def direction_summary(spark, sf):
    summary, _ = FA.analyze_direction(analysis_pool(spark, sf), ALL_TARGETS, None, BUCKETS, LEAST)
    # Places go by the rounded figures, so that equal ones stay equal in any engine.
    return FA.report_places(X.tidy(summary))


REFINE = f"""q1 AS (SELECT *, {O.rank_bucket('no', 'n', '10')} AS source_bucket, {O.rank_bucket('n', 'n', '10')} AS last_bucket FROM (SELECT *, row_number() OVER (PARTITION BY factor, target_col ORDER BY x, date, symbol) AS no, count(*) OVER (PARTITION BY factor, target_col) AS n FROM fr)),
q2 AS (SELECT factor, target_col, x, y, date, symbol, source_bucket, CASE WHEN source_bucket = 1 THEN 'lowest' ELSE 'highest' END AS source_bucket_type FROM q1
  WHERE source_bucket = 1 OR source_bucket = last_bucket),
q3 AS (SELECT *, {O.rank_bucket('no', 'n', '5')} AS sub_bucket FROM (SELECT *, row_number() OVER (PARTITION BY factor, target_col, source_bucket ORDER BY x, date, symbol) AS no,
  count(*) OVER (PARTITION BY factor, target_col, source_bucket) AS n, avg(y) OVER (PARTITION BY factor, target_col, source_bucket) AS source_mean FROM q2))"""


@query("extreme_refinement", O.pool_query(
    f"SELECT factor, target_col, source_bucket_type, source_bucket, sub_bucket, count(*) AS sample_count, {O.r4('min(x)')} AS sub_min_factor, {O.r4('max(x)')} AS sub_max_factor, {O.r4('median(x)')} AS sub_median_factor,"
    f" {O.r4('avg(y)')} AS mean_return, {O.r4('median(y)')} AS median_return, {O.r4('avg(y) - max(source_mean)')} AS mean_return_vs_source, count(*) >= 20 AS sample_ok FROM q3 GROUP BY 1, 2, 3, 4, 5",
    O.detected_rows(CANDIDATES, TARGETS), REFINE))
def extreme_refinement(spark, sf):
    pool = analysis_pool(spark, sf)
    names_ = FA.factor_columns(pool, ALL_TARGETS, FA.refinement_factors(pool.columns))
    _, detail = FA.refine_extremes(pool, names_, TARGETS, least=20)
    return detail.select(
        "factor", "target_col", "source_bucket_type", "source_bucket", "sub_bucket", "sample_count", "sub_min_factor", "sub_max_factor",
        "sub_median_factor", "mean_return", "median_return", "mean_return_vs_source", "sample_ok")


SAMPLE_OUT = "symbol date file selection_strategy open~ high~ low~ close~ volume~ amount~ " + " ".join(f"{t}~" for t in ALL_TARGETS)
SAMPLES = f"""bd AS (SELECT factor, target_col, bucket, unnest([{{'side': 'min', 'b': floor(min_factor * 10.0 + 0.5) / 10.0}}, {{'side': 'max', 'b': floor(max_factor * 10.0 + 0.5) / 10.0}}]) AS e FROM detail),
bv AS (SELECT DISTINCT factor, target_col, e.b AS bound FROM bd),
lo AS (SELECT v.factor, v.target_col, v.bound, max(r.x) AS below FROM bv v JOIN fr r ON r.factor = v.factor AND r.target_col = v.target_col AND r.x < v.bound GROUP BY ALL),
hi AS (SELECT v.factor, v.target_col, v.bound, min(r.x) AS above FROM bv v JOIN fr r ON r.factor = v.factor AND r.target_col = v.target_col AND r.x >= v.bound GROUP BY ALL),
nv AS (SELECT bv.*, below, above, greatest(abs(bound) * 1e-9, 1e-10) AS margin, least(coalesce(bound - below, 'inf'), coalesce(above - bound, 'inf')) AS away
  FROM bv LEFT JOIN lo USING (factor, target_col, bound) LEFT JOIN hi USING (factor, target_col, bound)),
ht AS (SELECT n.factor, n.target_col, n.bound, n.away <= n.margin AS exact, arg_min(row(r.symbol, r.date, r.x, r.y), row(r.date, r.symbol)) AS s FROM nv n JOIN fr r ON r.factor = n.factor AND r.target_col = n.target_col
  AND ((n.away <= n.margin AND abs(r.x - n.bound) <= n.margin) OR (n.away > n.margin AND ((r.x = n.below AND n.bound - n.below <= n.away) OR (r.x = n.above AND n.above - n.bound <= n.away)))) GROUP BY ALL)"""


@query("extreme_samples", O.analysis(
    f"SELECT bd.target_col, bd.factor, bd.bucket, e.side AS extreme_side, e.b AS bucket_extreme_value, {O.r4('s[3]')} AS sample_factor_value, CASE WHEN exact THEN 'exact' ELSE 'nearest' END AS match_type, {O.r4('s[4]')} AS target_value, p.*"
    f" FROM bd JOIN ht ON ht.factor = bd.factor AND ht.target_col = bd.target_col AND ht.bound = bd.e.b JOIN ({O.rounded(SAMPLE_OUT, 'b1v0')}) p ON p.symbol = s[1] AND p.date = s[2]",
    CANDIDATES, TARGETS, BUCKETS, LEAST, SAMPLES))
def extreme_samples(spark, sf):
    """Bounds as a report with one decimal shows them, so that most of them fall between rows."""
    pool = analysis_pool(spark, sf)
    detail = FA.analyze_direction(pool, TARGETS, FA.factor_columns(pool, ALL_TARGETS), BUCKETS, LEAST)[1]
    shown = detail.withColumns({c: F.floor(F.col(c) * 10.0 + 0.5).cast("double") / 10.0 for c in ("min_factor", "max_factor")})
    return FA.extreme_samples(pool, shown)


CHOSEN = {"kdj_j": [1, 2, 3, 4], "amplitude_pct": [4, 5, 6, 7]}
COMBO = O.pool_query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS target_col, count({t}) AS benchmark_sample_count, count({t}) FILTER (WHERE hit) AS combo_sample_count, {O.r4(f'count({t}) FILTER (WHERE hit) * 1.0 / count({t})')} AS coverage_ratio,"
        f" {O.r4(f'avg({t})')} AS benchmark_mean_return, {O.r4(f'avg({t}) FILTER (WHERE hit)')} AS combo_mean_return, {O.r4(f'avg({t}) FILTER (WHERE hit) - avg({t})')} AS excess_mean_return,"
        f" {O.r4(f'median({t})')} AS benchmark_median_return, {O.r4(f'median({t}) FILTER (WHERE hit)')} AS combo_median_return FROM hits" for t in TARGETS),
    "fr AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, CAST({f} AS DOUBLE) AS x FROM b1v0 WHERE {f} IS NOT NULL" for f in CHOSEN) + ")",
    O.cuts("factor", BUCKETS),
    "hits AS (SELECT *, " + " AND ".join(
        f"greatest(1, len(list_filter((SELECT edges FROM cuts WHERE factor = '{f}'), lambda v: v < {f}))) IN ({', '.join(map(str, bs))})" for f, bs in CHOSEN.items()) + " AS hit FROM b1v0)")


@query("multi_factor_combo", COMBO)
def multi_factor_combo(spark, sf):
    out = RP.combination_summary(analysis_pool(spark, sf), TARGETS, CHOSEN, BUCKETS)
    return out.select("target_col", "benchmark_sample_count", "combo_sample_count", "coverage_ratio", "benchmark_mean_return",
                      "combo_mean_return", "excess_mean_return", "benchmark_median_return", "combo_median_return")


# --------------------------------------------------------------------------
# single-factor view
# --------------------------------------------------------------------------

KINDS = {"kdj_j": "numeric", "is_range_low": "boolean"}
VIEW = f"""mk AS (SELECT symbol, date, {O.chg('t2_close', 't1_open')} AS t2_return_pct, {O.chg('t3_close', 't1_open')} AS t3_return_pct FROM lab WHERE t1_open IS NOT NULL),
mp AS (SELECT p.symbol, p.date, p.kdj_j, p.is_range_low, mk.t2_return_pct, mk.t3_return_pct FROM b1v0 p JOIN mk ON mk.symbol = p.symbol AND mk.date = p.date),
gr AS (SELECT * FROM (SELECT *, 'Q' || ({O.rank_bucket('no', 'n', 'least(5, lv)')}) AS kb, CASE WHEN is_range_low = 1 THEN 'True' ELSE 'False' END AS rb FROM (
  SELECT *, row_number() OVER (ORDER BY kdj_j, date, symbol) AS no, count(*) OVER () AS n, (SELECT count(DISTINCT kdj_j) FROM mp) AS lv FROM mp)) WHERE t2_return_pct IS NOT NULL OR t3_return_pct IS NOT NULL),
sel AS (SELECT * FROM gr WHERE kb IN ('Q1', 'Q2')),
base AS (SELECT * FROM mk WHERE date IN (SELECT date FROM sel) AND (t2_return_pct IS NOT NULL OR t3_return_pct IS NOT NULL))"""


def metrics(tag: str = "", source: str = "") -> str:
    return ", ".join(
        f"count({source}{p}_return_pct) AS {p}_sample_count{tag}, {O.r4(f'avg({source}{p}_return_pct)')} AS {p}_mean_return_pct{tag},"
        f" {O.r4(f'avg(CASE WHEN {source}{p}_return_pct > 0 THEN 1.0 ELSE 0.0 END) * 100.0')} AS {p}_win_rate_pct{tag}, {O.r4(f'median({source}{p}_return_pct)')} AS {p}_median_return_pct{tag}"
        for p in ("t2", "t3"))


def view_rows(spark, sf):
    """(bucketed pool rows, market rows)"""
    bars = stored_bars(spark, sf)
    market = L.market_labels(bars)
    pool = b1_pool(spark, sf, bars=bars).select("symbol", "date", *KINDS)
    rows = materialize(RP.match_market(pool, market), "matched")
    return materialize(RP.has_return(RP.factor_groups(rows, KINDS, 5)), "grouped"), market


@query("bucket_group_metrics", O.pool_query(
    f"SELECT 'kdj_j=' || kb || ' | is_range_low=' || rb AS bucket_group, {metrics()} FROM gr GROUP BY 1", VIEW))
def bucket_group_metrics(spark, sf):
    return RP.group_metrics(view_rows(spark, sf)[0])


WIDE_KINDS = {"kdj_j": "numeric", "amplitude_pct": "numeric", "close_to_ma20_pct": "numeric", "renko_value": "numeric", "is_range_low": "boolean"}
_Q = {f: f"'Q' || ({O.rank_bucket(f'no_{f}', f'n_{f}', f'least(5, lv_{f})')})" for f in ("kdj_j", "amplitude_pct", "close_to_ma20_pct", "renko_value")}


@query("factor_group_rows", O.pool_query(
    "SELECT symbol, date, " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {q} END AS {f}__bucket" for f, q in _Q.items()) + ", CASE WHEN is_range_low = 1 THEN 'True' ELSE 'False' END AS is_range_low__bucket FROM (SELECT *, "
    + ", ".join(f"row_number() OVER (ORDER BY {f} NULLS LAST, date, symbol) AS no_{f}, count({f}) OVER () AS n_{f}, (SELECT count(DISTINCT {f}) FROM b1v0) AS lv_{f}" for f in _Q) + " FROM b1v0)"))
def factor_group_rows(spark, sf):
    """Buckets of four factors from one rank pass, and of one flag."""
    pool = materialize(b1_pool(spark, sf).select("symbol", "date", *WIDE_KINDS), "grouped-pool")
    return RP.factor_groups(pool, WIDE_KINDS, 5).select("symbol", "date", *(f"{f}__bucket" for f in WIDE_KINDS))


@query("bucket_ranges", O.pool_query(
    f"SELECT 'kdj_j' AS factor, 'numeric' AS factor_type, kb AS bucket, {O.r4('min(kdj_j)')} AS factor_min, {O.r4('max(kdj_j)')} AS factor_max, {O.r4('median(kdj_j)')} AS factor_median, count(*) AS sample_count, count(DISTINCT date) AS date_count, {metrics()} FROM gr GROUP BY kb"
    f" UNION ALL SELECT 'is_range_low', 'boolean', rb, NULL, NULL, NULL, count(*), count(DISTINCT date), {metrics()} FROM gr GROUP BY rb", VIEW))
def bucket_ranges(spark, sf):
    # The rows are already one per sample, so the metrics' own counts are renamed apart.
    return RP.bucket_ranges(view_rows(spark, sf)[0], KINDS).drop("bucket_label")


@query("daily_comparison", O.pool_query(
    f"SELECT a.*, b.* EXCLUDE (date), {O.r4('a.x2 - b.x2')} AS t2_excess_mean_return_pct FROM (SELECT date, {metrics('_bucket')}, avg(t2_return_pct) AS x2 FROM sel GROUP BY date) a JOIN (SELECT date, {metrics('_baseline')}, avg(t2_return_pct) AS x2 FROM base GROUP BY date) b USING (date)".replace("a.*,", "a.* EXCLUDE (x2),").replace("EXCLUDE (date),", "EXCLUDE (date, x2),"), VIEW))
def daily_comparison(spark, sf):
    rows, market = view_rows(spark, sf)
    chosen = RP.pick_buckets(rows, {"kdj_j": ["Q1", "Q2"], "is_range_low": ["True", "False"]})
    out = RP.daily_comparison(chosen, RP.baseline_rows(chosen, market))
    return out.drop("t2_excess_win_rate_pct", "t3_excess_mean_return_pct", "t3_excess_win_rate_pct")


@query("selected_delta", O.pool_query(
    "SELECT " + ", ".join(f"a.{c} AS {c}, {O.r4(f'a.{c} - b.{c}') if 'count' not in c else f'a.{c} - b.{c}'} AS {c}_delta" for p in ("t2", "t3") for c in (f"{p}_sample_count",))
    + ", " + ", ".join(f"{O.r4(f'a.{c}')} AS {c}, {O.r4(f'a.{c} - b.{c}')} AS {c}_delta" for p in ("t2", "t3") for c in (f"{p}_mean", f"{p}_win", f"{p}_median"))
    + " FROM (SELECT 1 AS one, {m} FROM sel) a JOIN (SELECT 1 AS one, {m} FROM base) b USING (one)".replace("{m}", ", ".join(
        f"count({p}_return_pct) AS {p}_sample_count, avg({p}_return_pct) AS {p}_mean, avg(CASE WHEN {p}_return_pct > 0 THEN 1.0 ELSE 0.0 END) * 100.0 AS {p}_win, median({p}_return_pct) AS {p}_median" for p in ("t2", "t3"))), VIEW))
def selected_delta(spark, sf):
    rows, market = view_rows(spark, sf)
    chosen = RP.pick_buckets(rows, {"kdj_j": ["Q1", "Q2"], "is_range_low": ["True", "False"]})
    out = RP.overall_delta(chosen, RP.baseline_rows(chosen, market))
    short = {f"{p}_{long}{d}": f"{p}_{s}{d}" for p in ("t2", "t3") for d in ("", "_delta") for long, s in
             (("mean_return_pct", "mean"), ("win_rate_pct", "win"), ("median_return_pct", "median"))}
    return out.withColumnsRenamed(short)


@query("selected_detail", O.pool_query(
    f"SELECT symbol, date, {O.r4('kdj_j')} AS kdj_j, kb AS kdj_j__bucket, {O.r4('t2_return_pct')} AS t2_return_pct, {O.r4('t3_return_pct')} AS t3_return_pct FROM sel", VIEW))
def selected_detail(spark, sf):
    rows, _ = view_rows(spark, sf)
    chosen = RP.pick_buckets(rows, {"kdj_j": ["Q1", "Q2"]})
    return RP.selected_detail(chosen, list(KINDS)).select("symbol", "date", "kdj_j", "kdj_j__bucket", "t2_return_pct", "t3_return_pct")


# --------------------------------------------------------------------------
# alpha probe
# --------------------------------------------------------------------------

PANEL_OUT = (
    "symbol date ret_1d_pct~ ret_3d_pct~ ret_5d_pct~ ret_10d_pct~ ret_20d_pct~ ma5~ ma60~ close_to_ma5~ close_to_ma20~ high20~ low20~ close_pos20~"
    " volume_ma20~ volume_ratio20~ volatility20~ market_ret_1d_pct~ excess_1d_pct~ excess_5d_pct~ excess_20d_pct~ ret_T1~ ret_T3~")


@query("market_panel", O.query(O.rounded(PANEL_OUT, "panel"), O.PANEL))
def market_panel(spark, sf):
    return A.market_panel(X.bars(spark, sf)).select(*names(PANEL_OUT))


RANK_OUT = "symbol date rank_volatility_contract~ rank_pullback_ma20~ rank_cooldown_10d~ rank_cooldown_3d~ rank_cooldown_5d~"


@query("pct_rank", O.query(O.rounded(RANK_OUT, "score"), O.PANEL, O.SCORE))
def pct_rank(spark, sf):
    return A.alpha_score(A.market_panel(X.bars(spark, sf))).select(*names(RANK_OUT))


def scored(spark, sf, bars=None) -> DataFrame:
    panel = A.market_panel(X.bars(spark, sf) if bars is None else bars)
    return materialize(C.universe(A.alpha_score(panel), only_main_board=False), "scored")


@query("alpha_score", O.query(O.rounded("symbol date close~ alpha_score~", "uni"), O.PANEL, O.SCORE))
def alpha_score(spark, sf):
    return scored(spark, sf).select("symbol", "date", "close", "alpha_score")


@query("universe", O.query(O.rounded("symbol date close~ alpha_score~", "uni"), O.MAIN_PANEL, O.SCORE))
def universe(spark, sf):
    panel = A.market_panel(X.bars(spark, sf), only_main_board=True)
    return C.universe(A.alpha_score(panel), only_main_board=True).select("symbol", "date", "close", "alpha_score")


@query("alpha_top_n", O.query(O.rounded("symbol date alpha_rank alpha_score~", "top"), O.PANEL, O.SCORE))
def alpha_top_n(spark, sf):
    return A.daily_top(scored(spark, sf), TOP_N).select("symbol", "date", "alpha_rank", "alpha_score")


DAILY_OUT = (
    "date month horizon alpha_top_count alpha_top_up_count alpha_top_up_ratio~ alpha_top_avg_return_pct~ alpha_top_median_return_pct~ market_count market_up_count"
    " market_up_ratio~ market_avg_return_pct~ market_median_return_pct~ random_count random_avg_return_pct~ random_std_return_pct~ formal_union_count"
    " formal_union_up_count formal_union_up_ratio~ formal_union_avg_return_pct~ formal_union_median_return_pct~ excess_vs_market_pct~ excess_vs_random_pct~"
    " excess_vs_formal_union_pct~ excess_up_ratio_vs_market~")
FORMAL = "formal AS (SELECT DISTINCT symbol, date FROM b1v0)"
ALPHA = (O.PANEL, O.SCORE, FORMAL, O.HORIZONS, O.random_ctes(TOP_N, TRIALS, A.SEED), O.DAILY)


def daily(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(scored rows, daily statistics), both from the same bars."""
    bars = stored_bars(spark, sf, "wide")
    rows = scored(spark, sf, bars)
    formal = A.formal_union({"b1_pool": b1_pool(spark, sf, ST.B1_V0, bars=bars).select("symbol", "date")})
    return rows, A.daily_stats(rows, A.daily_top(rows, TOP_N), formal, top_n=TOP_N, trials=TRIALS)


@query("alpha_daily", O.pool_query(O.rounded(DAILY_OUT, "daily"), *ALPHA, price="wide"))
def alpha_daily(spark, sf):
    return daily(spark, sf)[1]


@query("random_benchmark", O.pool_query(O.rounded("date horizon random_count random_avg_return_pct~ random_std_return_pct~", "rnd"), *ALPHA[:-1], price="wide"))
def random_benchmark(spark, sf):
    return A.random_benchmark(A.horizon_rows(scored(spark, sf), (1, 2, 3), []), TOP_N, TRIALS)


MONTHLY_OUT = (
    "month horizon trading_days alpha_top_avg_return_pct~ market_avg_return_pct~ random_avg_return_pct~ formal_union_avg_return_pct~ excess_vs_market_pct~"
    " excess_vs_random_pct~ excess_vs_formal_union_pct~ positive_excess_days valid_excess_days positive_excess_day_ratio~")


@query("alpha_monthly", O.pool_query(O.rounded(MONTHLY_OUT, "monthly"), *ALPHA, O.MONTHLY, price="wide"))
def alpha_monthly(spark, sf):
    return A.monthly_stats(daily(spark, sf)[1])


GRID = "grid AS (SELECT date, horizon FROM (SELECT DISTINCT date FROM uni), (VALUES ('T1'), ('T2'), ('T3')) v(horizon))"


@query("rank_ic", O.query(O.rounded("date month horizon count rank_ic~", "ric"), O.PANEL, O.SCORE, GRID, O.FEATURE_IC))
def rank_ic(spark, sf):
    return A.rank_ic(scored(spark, sf), least=LEAST_IC)[0]


@query("feature_ic", O.query(
    O.rounded("date month horizon feature count rank_ic~", "fic", "WHERE EXISTS (SELECT 1 FROM ric WHERE ric.date = fic.date AND ric.horizon = fic.horizon AND ric.count >= 10)"),
    O.PANEL, O.SCORE, GRID, O.FEATURE_IC))
def feature_ic(spark, sf):
    return A.rank_ic(scored(spark, sf), least=LEAST_IC)[1]


_POS = "avg(CASE WHEN {0} > 0 THEN 1.0 WHEN {0} <= 0 THEN 0.0 END)"


@query("alpha_summary", O.pool_query(
    f"SELECT d.*, {O.r4('m.pm')} AS positive_excess_month_ratio, {O.r4('i.a')} AS avg_rank_ic, {O.r4('i.md')} AS median_rank_ic, {O.r4('i.p')} AS positive_rank_ic_ratio FROM (SELECT horizon, count(*) AS daily_rows, "
    + ", ".join(f"{O.r4(f'avg({c})')} AS {n}" for n, c in {
        "avg_alpha_top_return_pct": "alpha_top_avg_return_pct", "avg_market_return_pct": "market_avg_return_pct", "avg_random_return_pct": "random_avg_return_pct",
        "avg_formal_union_return_pct": "formal_union_avg_return_pct", "avg_excess_vs_market_pct": "excess_vs_market_pct",
        "avg_excess_vs_random_pct": "excess_vs_random_pct", "avg_excess_vs_formal_union_pct": "excess_vs_formal_union_pct"}.items())
    + f", {O.r4(_POS.format('excess_vs_market_pct'))} AS positive_excess_day_ratio FROM daily GROUP BY horizon) d"
    f" JOIN (SELECT horizon, {_POS.format('excess_vs_market_pct')} AS pm FROM monthly GROUP BY horizon) m USING (horizon)"
    f" JOIN (SELECT horizon, avg(rank_ic) AS a, median(rank_ic) AS md, {_POS.format('rank_ic')} AS p FROM ric GROUP BY horizon) i USING (horizon)",
    *ALPHA, O.MONTHLY, O.FEATURE_IC, price="wide"))
def alpha_summary(spark, sf):
    rows, by_day = daily(spark, sf)
    by_day = materialize(by_day, "daily")
    return A.alpha_summary(by_day, A.monthly_stats(by_day), A.rank_ic(rows, least=LEAST_IC)[0])


# --------------------------------------------------------------------------
# exports and parsing
# --------------------------------------------------------------------------

@query("full_market", O.query(O.rounded("symbol date open~ high~ low~ close~ volume~ amount~", "bars", "WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")))
def full_market_query(spark, sf):
    return full_market(X.bars(spark, sf), "1996-01-01", "2000-12-31", keep_symbol=True).drop("file")


@query("code_export", (
    "SELECT code, CAST(row_number() OVER (ORDER BY first_seen) AS BIGINT) AS pos FROM (SELECT CASE WHEN length(t) < 6 THEN lpad(t, 6, '0') ELSE t END AS code, min(o_orderkey) AS first_seen"
    " FROM (SELECT CAST(o_custkey AS VARCHAR) AS t, o_orderkey FROM orders) GROUP BY 1)"))
def code_export(spark, sf):
    orders = X.table(spark, sf, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("code"), "o_orderkey")
    return code_list(orders, "code", order="o_orderkey")


@query("symbol_normalize", (
    "SELECT c_custkey, CASE WHEN length(d) >= 6 THEN right(d, 6) WHEN d = '' THEN '' ELSE lpad(d, 6, '0') END AS digits_only,"
    " CASE WHEN regexp_extract(c_name, '([0-9]{6})', 1) <> '' THEN regexp_extract(c_name, '([0-9]{6})', 1) WHEN length(d) >= 6 THEN right(d, 6) WHEN d = '' THEN '' ELSE lpad(d, 6, '0') END AS first_run"
    " FROM (SELECT *, regexp_replace(c_name, '[^0-9]', '', 'g') AS d FROM customer)"))
def symbol_normalize(spark, sf):
    return X.table(spark, sf, "customer").select(
        "c_custkey", S.normalize_symbol("c_name").alias("digits_only"), S.first_code("c_name").alias("first_run"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: bars, indicators, selection and labels, summarised per horizon."""
    return QUERIES["forward_curve"](spark, sf_dir)
