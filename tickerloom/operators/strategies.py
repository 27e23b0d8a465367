"""Selection strategies: bars with indicators in, selected rows out.

Strategies run on complete history and filter last, so a refreshed window gives
exactly the rows a full build would.  Every input column is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import rolling as R
from tickerloom.functions.recursive import Away, LastEvent, Previous, ema
from tickerloom.functions.scalars import as_flag, change_pct, extend, first_code, is_true, ratio, ratio_or
from tickerloom.operators import indicators as I
from tickerloom.operators.cleaning import selected_rows
from tickerloom.scratch import materialize

B1_V0 = "b1_stage_low_select_strategy_v0"
B1_V1 = "b1_stage_low_select_strategy_v1"
B2_INLINE = "b2_confirm_tdx_b1_v0"
B2_FROM_B1 = "b2_confirm_from_b1_v0"

@dataclass(frozen=True)
class Strategy:
    """A selection rule in two parts.

    ``block`` lists the columns to compute per symbol; ``finish`` turns them into
    flags and keeps the selected rows.  A pool build merges the block with its own
    indicators so both share one pass; calling the strategy runs it on its own.
    """

    name: str
    block: Callable[..., I.Block]
    finish: Callable[..., DataFrame]
    prepare: Callable[..., DataFrame] = lambda df, **_: df

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        _require(df, self.name)
        df = self.prepare(df, **params)
        return self.finish(I.run(df, self.block(df.columns, **params)), **params)


_REGISTRY: dict[str, Strategy] = {}


def register(item: Strategy) -> Strategy:
    if item.name in _REGISTRY:
        raise ValueError(f"strategy already registered: {item.name}")
    _REGISTRY[item.name] = item
    return item


def get_strategy(name: str) -> Strategy:
    if name not in _REGISTRY:
        raise KeyError(f"unknown strategy {name}; known: {strategy_names()}")
    return _REGISTRY[name]


def strategy_names() -> list[str]:
    return sorted(_REGISTRY)


def _require(df: DataFrame, name: str) -> None:
    missing = [c for c in ("date", "symbol", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise ValueError(f"{name} missing required columns: {missing}")


# --------------------------------------------------------------------------
# B1: stage low
# --------------------------------------------------------------------------

def stage_low_block(columns=(), support_lookback: int = 20, range_lookback: int = 60, structure: bool = False, **_) -> I.Block:
    """KDJ, support, 60-bar range and distance columns; cached ones are reused."""
    have = set(columns)
    volume = {k: v for k, v in I.volume_columns().items() if k.startswith("volume_ratio_ma")}
    facts = {k: v for k, v in {**I.moving_average_columns((20, 60)), **volume}.items() if k not in have}
    block = I.Block(
        windows=[
            *I.average_needs((20, 60)), *I.volume_needs(), *I.support_needs(support_lookback),
            *I.range_needs(range_lookback), *(I.downtrend_needs(20) if structure else []),
        ],
        columns={
            **facts,
            **I.support_columns(support_lookback),
            **I.range_columns(range_lookback),
            **({"b1_structure_downtrend_20": I.downtrend_flag(20)} if structure else {}),
        },
        after={
            "close_to_ma20_pct": change_pct("close", "ma20"),
            "close_to_ma60_pct": change_pct("close", "ma60"),
        },
    )
    if {"kdj_k", "kdj_d", "kdj_j"} <= have:
        return block + I.Block(steps=[Previous("b1_tminus1_j", "kdj_j")])
    return block + I.kdj_loose(previous_j="b1_tminus1_j")


def _stage_low_flags(
    df: DataFrame,
    j_threshold: float,
    support_break_tolerance_pct: float,
    uptrend_ma60_floor_pct: float,
    uptrend_ma20_ceiling_pct: float,
    range_width_60d_max_pct: float,
    range_low_position_max_pct: float,
) -> DataFrame:
    floor = "previous_20d_low"
    return extend(df, {
        "b1_j_low": as_flag(f"kdj_j < {j_threshold}D"),
        "b1_not_break_previous_20d_low": as_flag(
            f"low >= {floor} * {1.0 - support_break_tolerance_pct / 100.0}D AND close >= {floor}"),
        "is_uptrend_pullback": as_flag(
            f"ma20 > ma60 AND close_to_ma60_pct >= {uptrend_ma60_floor_pct}D"
            f" AND close_to_ma20_pct <= {uptrend_ma20_ceiling_pct}D"),
        "is_range_low": as_flag(
            f"range_60d_pct <= {range_width_60d_max_pct}D AND close_position_60d_pct <= {range_low_position_max_pct}D"),
    })


LIMITS = {
    "j_threshold": 14.0, "support_break_tolerance_pct": 2.0, "uptrend_ma60_floor_pct": -3.0,
    "uptrend_ma20_ceiling_pct": 3.0, "range_width_60d_max_pct": 35.0, "range_low_position_max_pct": 35.0,
}


def _stage_low_finish(df: DataFrame, name: str, structure: bool, keep_all: bool = False, **params) -> DataFrame:
    df = _stage_low_flags(df, **{k: float(params.get(k, v)) for k, v in LIMITS.items()})
    hit = "b1_j_low = 1" + (" AND b1_structure_downtrend_20 = 0" if structure else "")
    valid = f"{hit} AND b1_not_break_previous_20d_low = 1 AND (is_uptrend_pullback = 1 OR is_range_low = 1)"
    df = extend(df, {"b1_stage_low_valid": as_flag(valid), "selection_strategy": f"'{name}'"})
    return extend(df, {"selected": as_flag(hit)}) if keep_all else df.filter(hit)


# Rows whose J is below the threshold; the other checks stay as factors.
stage_low_v0 = register(Strategy(B1_V0, stage_low_block, partial(_stage_low_finish, name=B1_V0, structure=False)))
# The same without rows in a 20-bar structural downtrend.
stage_low_v1 = register(Strategy(
    B1_V1, partial(stage_low_block, structure=True), partial(_stage_low_finish, name=B1_V1, structure=True)))


# --------------------------------------------------------------------------
# B2: confirmation, with the B1 condition evaluated inline
# --------------------------------------------------------------------------

# Limits of the inline rule.
CONFIRM = {
    "position_max": 0.25, "near_low_max": 0.02, "j_low_max": 14.0, "quiet_days_min": 16.0, "quiet_ratio_max": 0.70, "low_tolerance": 0.98,
    "signal_window": 5, "return_min_pct": 4.0, "j_max": 55.0, "upper_shadow_max": 0.25,
}


def _event_block(full, bbi: str, **params) -> I.Block:
    """The last B1 signal before each bar, found in the pass that computes the averages it depends on.

    What rests on windows alone comes in as two numbers; J and the distance to the EMA line join it there, so bars
    need no further exchange by symbol afterwards.
    """
    p = CONFIRM | {k: v for k, v in params.items() if k in CONFIRM}
    top, bottom, floor = R.highest("high", 20), R.lowest("low", 20), R.lowest("low", 20, shift=1)
    ratio5 = I.volume_columns((5, 10), full)["volume_ratio_ma5"]

    def near(line: str) -> str:
        return is_true(f"{ratio_or(f'abs(close - {line})', line, 999.0)} <= {p['near_low_max']}D")

    low = is_true(f"{ratio_or(f'(close - {bottom})', f'({top} - {bottom})', 999.0)} <= {p['position_max']}D")
    old = is_true(f"abs({ratio_or(f'(close - {floor})', floor, 999.0)}) <= {p['near_low_max']}D")
    quiet = f"({is_true(f'({I.low_volume_column(20)}) >= {p["quiet_days_min"]}D')} OR {is_true(f'({ratio5}) <= {p["quiet_ratio_max"]}D')})"
    held = is_true(f"low >= {floor} * {p['low_tolerance']}D AND close >= {floor}")
    return I.Block(
        inputs={
            "_place": f"CAST({low} OR {old} OR {near(R.mean('close', 20))} OR {near(f'({bbi})')} AS DOUBLE)", "_ready": f"CAST({quiet} AND {held} AS DOUBLE)",
            "_day": "CAST(datediff(date, DATE '1970-01-01') AS DOUBLE)",
        },
        steps=[
            Away("_i_zsl_away", "close", "b1_tdx_zsl_ema21"),
            LastEvent("_event_since", "_event_day", "_day", (("_ready", "at least", 1.0), ("kdj_j", "at most", p["j_low_max"])),
                      (("_place", "at least", 1.0), ("_i_zsl_away", "at most", p["near_low_max"]))),
        ],
    )


def confirm_block(columns=(), **params) -> I.Block:
    """Full-window averages (replacing cached ones), strict KDJ, doubled MACD bar, 20-bar context, last B1 signal."""
    full = int
    bbi = f"({' + '.join(R.mean('close', w) for w in (3, 6, 12, 24))}) / 4.0D"
    facts = I.Block(
        windows=[
            *I.KLINE_NEEDS, *I.volume_needs((5, 10)), *I.average_needs((3, 5, 6, 10, 12, 20, 24, 60)),
            *R.needs("max", "high", 20), *R.needs("min", "low", 20), *R.needs("min", "low", 20, shift=1),
            *I.low_volume_needs(20),
        ],
        columns={
            **I.kline_columns(),
            **I.volume_columns((5, 10), full),
            **I.moving_average_columns((5, 10, 20, 60), full),
            "b1_tdx_range_high_20": R.highest("high", 20),
            "b1_tdx_range_low_20": R.lowest("low", 20),
            "b1_tdx_previous_20d_low": R.lowest("low", 20, shift=1),
            "b1_tdx_bbi": bbi,
            "b1_tdx_low_volume_count_20": I.low_volume_column(20),
        },
        steps=[ema("b1_tdx_zsl_ema21", "close", 21)],
    )
    return facts + I.kdj_strict() + I.macd(bar_scale=2.0) + _event_block(full, bbi, **params)


def confirm_flags(df: DataFrame, **params) -> DataFrame:
    """All B1/B2 conditions as columns, plus ``_selected``."""
    p = CONFIRM | {k: v for k, v in params.items() if k in CONFIRM}
    position_max, near_low_max, low_tolerance = p["position_max"], p["near_low_max"], p["low_tolerance"]
    top, bottom, floor = (f"b1_tdx_{x}" for x in ("range_high_20", "range_low_20", "previous_20d_low"))

    def away(line: str) -> str:
        return ratio_or(f"abs(close - {line})", line, 999.0)

    df = extend(df, {
        "b1_tdx_range_width_20": ratio_or(f"({top} - {bottom})", bottom, 999.0),
        "b1_tdx_position_20": ratio_or(f"(close - {bottom})", f"({top} - {bottom})", 999.0),
        "b1_tdx_close_to_previous_20d_low": ratio_or(f"(close - {floor})", floor, 999.0),
        "b1_tdx_distance_to_ma20": away("ma20"),
        "b1_tdx_distance_to_bbi": away("b1_tdx_bbi"),
        "b1_tdx_distance_to_zsl": away("b1_tdx_zsl_ema21"),
        "b2_tdx_upper_shadow_ratio": ratio_or("(high - greatest(open, close))", "(high - low)", 999.0),
    })
    # Each comparison is a complete truth value before it is combined: missing means no.
    low_position = f"b1_tdx_position_20 <= {position_max}D"
    support = " OR ".join(is_true(f"b1_tdx_distance_to_{x} <= {near_low_max}D") for x in ("ma20", "bbi", "zsl"))
    df = extend(df, {
        "b1_tdx_low_position": as_flag(low_position),
        "b1_tdx_near_previous_low": as_flag(f"abs(b1_tdx_close_to_previous_20d_low) <= {near_low_max}D"),
        "b1_tdx_bottom_zone": as_flag(
            f"b1_tdx_range_width_20 <= {position_max}D AND {low_position} AND close >= {bottom} * {low_tolerance}D"),
        "b1_tdx_ma_support": as_flag(support),
        "b1_tdx_j_ok": as_flag(f"kdj_j <= {p['j_low_max']}D"),
        "b1_tdx_low_volume": as_flag(
            f"{is_true(f'b1_tdx_low_volume_count_20 >= {p['quiet_days_min']}D')}"
            f" OR {is_true(f'volume_ratio_ma5 <= {p['quiet_ratio_max']}D')}"),
        "b1_tdx_not_break_previous_low": as_flag(f"low >= {floor} * {low_tolerance}D AND close >= {floor}"),
        "b2_tdx_return_gt_4": as_flag(f"daily_return_pct > {p['return_min_pct']}D"),
        "b2_tdx_bullish_candle": as_flag("close > open"),
        "b2_tdx_volume_gt_prev": as_flag("volume > prev_volume"),
        "b2_tdx_j_below_55": as_flag(f"kdj_j < {p['j_max']}D"),
        "b2_tdx_upper_shadow_ok": as_flag(f"b2_tdx_upper_shadow_ratio <= {p['upper_shadow_max']}D"),
    })
    where_ok = " + ".join(f"b1_tdx_{x}" for x in ("low_position", "near_previous_low", "bottom_zone", "ma_support"))
    df = extend(df, {"b1_tdx_position_ok": as_flag(f"{where_ok} > 0")})
    df = extend(df, {"b1_tdx_signal": as_flag(
        "b1_tdx_position_ok = 1 AND b1_tdx_j_ok = 1 AND b1_tdx_low_volume = 1 AND b1_tdx_not_break_previous_low = 1")})
    # The pass over each symbol has found the last signal before each bar.
    df = extend(df, {
        "b1_tdx_recent_1_to_5": as_flag(f"_event_since <= {int(p['signal_window'])}"), "b1_lag_trade_days": "CAST(_event_since AS INT)",
        "b1_date": "date_add(DATE '1970-01-01', CAST(_event_day AS INT))",
    }).drop("_event_since", "_event_day")
    chosen = " AND ".join(f"{x} = 1" for x in (
        "b1_tdx_recent_1_to_5", "b2_tdx_return_gt_4", "b2_tdx_bullish_candle", "b2_tdx_volume_gt_prev",
        "b2_tdx_j_below_55", "b2_tdx_upper_shadow_ok"))
    return extend(df, {"_selected": as_flag(chosen)})


def with_last_event(df: DataFrame, event: str) -> DataFrame:
    """Date of the last event strictly before each row and its distance in bars."""
    before = f"({R.BY_SYMBOL_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    df = extend(df, {"_pos": f"row_number() OVER ({R.BY_SYMBOL_SQL})"})
    df = extend(df, {"_event": f"last(CASE WHEN {event} THEN struct(_pos, date) END, true) OVER {before}"})
    df = extend(df, {"b1_date": "_event.date", "b1_lag_trade_days": "CAST(_pos - _event._pos AS INT)"})
    return df.drop("_pos", "_event")


def mark_rows(bars: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """Flag the bars whose (symbol, date) is listed in ``marks``.

    The marks travel with the bars in the one exchange by symbol that the
    windows need anyway; a join on (symbol, date) would reshuffle both sides.
    """
    both = bars.withColumn(name, F.lit(None).cast("boolean")).unionByName(
        marks.select("symbol", "date", F.lit(True).alias(name)), allowMissingColumns=True
    )
    hit = F.max(name).over(Window.partitionBy("symbol", "date"))
    return R.by_symbol(both).withColumn(name, F.coalesce(hit, F.lit(False))).filter(F.col("close").isNotNull())


def _confirm_finish(df: DataFrame, **params) -> DataFrame:
    df = confirm_flags(df, **params).filter("_selected = 1").drop("_selected")
    return extend(df, {
        "selection_strategy": f"'{B2_INLINE}'",
        "b1_source_strategy": "'tdx_formula_inline_from_daily_cache'",
    })


confirm_inline = register(Strategy(
    B2_INLINE, confirm_block, _confirm_finish, prepare=lambda df, **_: df.filter(F.col("volume").isNotNull())))


# --------------------------------------------------------------------------
# B2: confirmation of rows in an existing B1 pool
# --------------------------------------------------------------------------

def _from_pool_prepare(df: DataFrame, *, b1_pool: DataFrame, **_) -> DataFrame:
    """Bars of symbols with a B1 row, with the last B1 date before each bar."""
    marks = selected_rows(b1_pool).select(
        first_code("symbol").alias("symbol"), F.col("date").cast("date").alias("date")
    ).filter((F.col("symbol") != "") & F.col("date").isNotNull()).distinct()
    # Used twice, and the pool behind it may be a whole build.
    marks = materialize(marks, "b1-marks")
    # Symbols without a B1 row cannot confirm one: drop their bars before any window.
    df = df.join(marks.select("symbol").distinct(), "symbol", "left_semi")
    df = mark_rows(df, marks, "_b1")
    return with_last_event(df, "_b1").drop("_b1")


def _from_pool_block(columns=(), **_) -> I.Block:
    have = set(columns)
    wanted = {**I.kline_columns(), **I.volume_columns()}
    colours = ("is_red_k", "is_green_k", "is_flat_k")
    block = I.Block(
        windows=[*I.KLINE_NEEDS, *I.volume_needs()],
        columns={k: v for k, v in wanted.items() if k in colours or k not in have},
    )
    return block if {"kdj_k", "kdj_d", "kdj_j"} <= have else block + I.kdj_loose()


def _from_pool_finish(
    df: DataFrame,
    *,
    max_days_after_b1: int = 5,
    return_threshold_pct: float = 4.0,
    min_volume_ratio_prev1: float = 1.0,
    j_max: float = 55.0,
    max_upper_shadow_pct: float | None = None,
    no_long_shadow_pct: float = 2.0,
    near_limit_pct: float = 9.0,
    mid_large_pct: float = 6.0,
    **_,
) -> DataFrame:
    """Bars that confirm a B1 row one to ``max_days_after_b1`` bars earlier."""
    chosen = (
        f"b1_lag_trade_days BETWEEN 1 AND {int(max_days_after_b1)} AND daily_return_pct > {return_threshold_pct}D"
        f" AND volume_ratio_prev1 > {min_volume_ratio_prev1}D AND kdj_j < {j_max}D"
    )
    if max_upper_shadow_pct is not None:
        chosen += f" AND upper_shadow_pct <= {float(max_upper_shadow_pct)}D"
    return extend(df.filter(chosen), {
        "selection_strategy": f"'{B2_FROM_B1}'",
        "b1_source_strategy": f"'{B1_V1}'",
        "b2_daily_return_gt_threshold": "1",
        "b2_volume_gt_prev1": "1",
        "b2_j_below_max": "1",
        "b2_no_long_upper_shadow": as_flag(f"upper_shadow_pct <= {no_long_shadow_pct}D"),
        "b2_close_position_pct": f"{ratio('(close - low)', '(high - low)')} * 100.0D",
        "b2_near_limit_up": as_flag(f"daily_return_pct >= {near_limit_pct}D"),
        "b2_mid_large_positive": as_flag(f"daily_return_pct >= {mid_large_pct}D"),
    })


confirm_from_pool = register(Strategy(B2_FROM_B1, _from_pool_block, _from_pool_finish, prepare=_from_pool_prepare))
