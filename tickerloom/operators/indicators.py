"""Per-symbol technical indicators.

Everything is a window expression over bars hash-partitioned by symbol, except
the recursive averages, which share one grouped Arrow pass on the same
partitioning.  A pipeline collects its ``Block``s, so that one exchange, one
sort, one window step and one pass serve all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import rolling as R
from tickerloom.functions.recursive import INTERNAL, MEMORY_TYPE, Kernel, Mix, Previous, add_recursive, ema, inputs_of, outputs, weighted
from tickerloom.functions.scalars import as_flag, change_pct, extend, project, ratio, ratio_or
from tickerloom.operators.audit import apply_audited, check_kernels
from tickerloom.scratch import materialize

MA_WINDOWS = (5, 10, 20, 60)
VOLUME_WINDOWS = (5, 10)
LONG_TREND_WINDOWS = (5, 10, 20, 60)

BASE_COLUMNS = ["symbol", "file", "date", "open", "high", "low", "close", "volume", "amount"]

KLINE_COLUMNS = [
    "daily_return_pct", "intraday_return_pct", "amplitude_pct", "upper_shadow_pct",
    "lower_shadow_pct", "body_pct", "body_abs_pct", "is_red_k", "is_green_k", "is_flat_k",
]


# --------------------------------------------------------------------------
# candles, averages, volume
# --------------------------------------------------------------------------

KLINE_NEEDS = [*R.needs("lag", "close", 1), *R.needs("lag", "volume", 1)]


def kline_columns() -> dict[str, str]:
    """Candle shape in percent of the previous close, plus colour flags."""
    prev = R.previous("close")
    body = f"{ratio('close - open', prev)} * 100.0D"
    return {
        "prev_close": prev,
        "prev_volume": R.previous("volume"),
        "daily_return_pct": change_pct("close", prev),
        "intraday_return_pct": change_pct("close", "open"),
        "amplitude_pct": f"{ratio('high - low', prev)} * 100.0D",
        "body_pct": body,
        "body_abs_pct": f"abs({body})",
        "upper_shadow_pct": f"{ratio('high - greatest(open, close)', prev)} * 100.0D",
        "lower_shadow_pct": f"{ratio('least(open, close) - low', prev)} * 100.0D",
        "is_red_k": as_flag("close > open"),
        "is_green_k": as_flag("close < open"),
        "is_flat_k": as_flag("close = open"),
    }


def _derive(df: DataFrame, wanted: list[R.Need], columns: dict[str, str]) -> DataFrame:
    return R.detach(extend(R.attach(df, wanted), columns), like=df)


def kline(df: DataFrame) -> DataFrame:
    return _derive(df, KLINE_NEEDS, kline_columns())


def canonical_kline(df: DataFrame) -> DataFrame:
    """Overwrite candle columns, whatever a stale cache holds, plus the volume ratio."""
    keep = {k: v for k, v in kline_columns().items() if not k.startswith("is_")}
    return _derive(df, KLINE_NEEDS, {**keep, "volume_ratio_prev1": volume_columns(())["volume_ratio_prev1"]})


def fill_missing_kline(df: DataFrame) -> DataFrame:
    """Add only the candle and volume columns a cache lacks; refresh the colour flags."""
    wanted = {**kline_columns(), **volume_columns()}
    present = set(df.columns)
    colours = {"is_red_k", "is_green_k", "is_flat_k"}
    missing = {k: v for k, v in wanted.items() if k in colours or k not in present}
    return _derive(df, [*KLINE_NEEDS, *volume_needs()], missing)


def average_needs(windows: Iterable[int] = MA_WINDOWS) -> list[R.Need]:
    return R.needs("avg", "close", *windows)


def moving_average_columns(windows: Iterable[int] = MA_WINDOWS, warmup: Callable[[int], int] = R.loose) -> dict[str, str]:
    return {f"ma{w}": R.mean("close", w, warmup(w)) for w in windows if w > 0}


def moving_averages(df: DataFrame, windows=MA_WINDOWS, warmup: Callable[[int], int] = R.loose) -> DataFrame:
    return _derive(df, average_needs(windows), moving_average_columns(windows, warmup))


def volume_needs(windows: Iterable[int] = VOLUME_WINDOWS) -> list[R.Need]:
    return [*R.needs("lag", "volume", 1), *R.needs("avg", "volume", *windows)]


def volume_columns(windows: Iterable[int] = VOLUME_WINDOWS, warmup: Callable[[int], int] = R.loose) -> dict[str, str]:
    out = {"volume_ratio_prev1": ratio("volume", R.previous("volume"))}
    for w in windows:
        if w > 0:
            avg = R.mean("volume", w, warmup(w))
            out[f"volume_ma{w}"] = avg
            out[f"volume_ratio_ma{w}"] = ratio("volume", avg)
    return out


def volume_ratios(df: DataFrame, windows=VOLUME_WINDOWS, warmup: Callable[[int], int] = R.loose) -> DataFrame:
    return _derive(df, volume_needs(windows), volume_columns(windows, warmup))


# --------------------------------------------------------------------------
# recursive indicators
# --------------------------------------------------------------------------

@dataclass
class Block:
    """What a set of indicators asks of a pipeline.

    ``windows`` are attached first; ``columns`` and ``inputs`` are projected from
    them (inputs only feed the recursive ``steps``); ``after`` is projected last.
    """

    windows: list[R.Need] = field(default_factory=list)
    columns: dict[str, str | Column] = field(default_factory=dict)
    inputs: dict[str, str | Column] = field(default_factory=dict)
    steps: list = field(default_factory=list)
    after: dict[str, str | Column] = field(default_factory=dict)
    scratch: set[str] = field(default_factory=set)

    def __add__(self, other: "Block") -> "Block":
        """Both blocks; on equal names the right-hand definition wins."""
        renamed = {c for s in other.steps for c in outputs(s)}
        return Block(
            [*self.windows, *other.windows],
            {**{k: v for k, v in self.columns.items() if k not in other.after}, **other.columns},
            {**self.inputs, **other.inputs},
            [*[s for s in self.steps if not renamed & set(outputs(s))], *other.steps],
            {**{k: v for k, v in self.after.items() if k not in other.columns}, **other.after},
            self.scratch | other.scratch,
        )


def run(df: DataFrame, block: Block, carry: bool = False) -> DataFrame:
    """Evaluate a block over bars, appending its columns.

    Only bars and the inputs of the recursive steps go through the pass over each symbol.  All other windows
    are computed after it, so nothing travels that is not asked for, and windows whose result is not used are not computed;
    where they are used they need one more exchange.  With ``carry`` all columns travel through the pass instead, and bars that
    are already together by symbol need no exchange.
    """
    original, emitted = df, [c for s in block.steps for c in outputs(s) if not c.startswith(INTERNAL)]
    columns = {k: v for k, v in block.columns.items() if k not in emitted}
    made = {c for s in block.steps for c in outputs(s)}
    read = {n for s in block.steps for n in inputs_of(s)} - made
    if carry and block.steps:
        df = extend(R.attach(df, block.windows), {**block.columns, **block.inputs})
        df = add_recursive(R.detach(df, like=original), block.steps, drop=set(block.inputs))
    else:
        if block.steps:
            feeds = {k: v for k, v in {**block.columns, **block.inputs}.items() if k in read}
            # An input that hides a column of the bars gives it back after the pass.
            hidden = [c for c in original.columns if c in feeds]
            fed = extend(R.attach(df, block.windows).withColumns({f"_own_{c}": F.col(c) for c in hidden}), feeds)
            fed = fed.select(*original.columns, *[c for c in feeds if c not in hidden], *[f"_own_{c}" for c in hidden])
            df = add_recursive(fed, block.steps, drop=set(feeds)).withColumnsRenamed({f"_own_{c}": c for c in hidden})
        df = R.detach(extend(R.attach(df, block.windows), columns), like=original)
        replaced = {*columns, *block.inputs, *emitted}
        df = df.select(*[c for c in original.columns if c not in replaced], *columns, *emitted)
    if block.after:
        df = extend(df, block.after)
    return df.drop(*block.scratch) if block.scratch else df


def macd(fast: int = 12, slow: int = 26, signal: int = 9, bar_scale: float = 1.0) -> Block:
    return Block(
        steps=[
            ema("_i_ema_fast", "close", fast),
            ema("_i_ema_slow", "close", slow),
            Mix("macd_dif", "_i_ema_fast", "_i_ema_slow"),
            ema("macd_dea", "macd_dif", signal),
            Mix("macd_hist", "macd_dif", "macd_dea", bar_scale, -bar_scale),
        ],
    )


def renko(n1: int = 4, n2: int = 6, prefix: str = "renko") -> Block:
    """Brick value: smoothed position in the n1-bar range, cut below n1."""
    if n1 <= 0 or n2 <= 0:
        raise ValueError("brick windows must be positive")
    top, bottom = R.highest("high", n1), R.lowest("low", n1)
    height = f"({top} - {bottom})"
    return Block(
        windows=[*R.needs("max", "high", n1), *R.needs("min", "low", n1)],
        inputs={
            "_from_top": f"{ratio(f'({top} - close)', height)} * 100.0D - 90.0D",
            "_from_bottom": f"{ratio(f'(close - {bottom})', height)} * 100.0D",
        },
        steps=[
            weighted("_i_brick_down", "_from_top", n1, gaps="hold"),
            weighted("_i_brick_mid", "_from_bottom", n2, gaps="hold"),
            weighted("_i_brick_up", "_i_brick_mid", n2, gaps="hold"),
            Mix("_brick_gap", "_i_brick_up", "_i_brick_down"),
        ],
        after={f"{prefix}_value": f"CASE WHEN _brick_gap > {n1} THEN _brick_gap - {n1} ELSE 0.0D END"},
        scratch={"_brick_gap"},
    )


def z_trend(short_span: int = 10, long_windows: Iterable[int] = LONG_TREND_WINDOWS) -> Block:
    windows = tuple(int(w) for w in long_windows)
    if len(windows) != 4:
        raise ValueError(f"the long trend line needs exactly four windows, got {windows}")
    long_line = f"({' + '.join(R.mean('close', w, 1) for w in windows)}) / 4.0D"
    return Block(
        windows=R.needs("avg", "close", *windows),
        columns={"z_long_trend_line": long_line},
        steps=[ema("_i_z_inner", "close", short_span), ema("z_short_trend_line", "_i_z_inner", short_span)],
    )


def _kdj(n: int, rsv: str, k: int, d: int, previous_j: str | None) -> Block:
    return Block(
        windows=[*R.needs("max", "high", n), *R.needs("min", "low", n)],
        inputs={"_rsv": rsv},
        steps=[
            weighted("kdj_k", "_rsv", k),
            weighted("kdj_d", "kdj_k", d),
            Mix("kdj_j", "kdj_k", "kdj_d", 3.0, -2.0),
            *([Previous(previous_j, "kdj_j")] if previous_j else []),
        ],
    )


def kdj_loose(n: int = 9, k: int = 3, d: int = 3, previous_j: str | None = None) -> Block:
    """Short warm-up, clipped to 0..100, and a flat range counts as missing."""
    top, bottom = R.highest("high", n, R.loose(n)), R.lowest("low", n, R.loose(n))
    raw = f"{ratio(f'(close - {bottom})', f'({top} - {bottom})')} * 100.0D"
    clipped = f"CASE WHEN {raw} IS NOT NULL THEN greatest(0.0D, least(100.0D, {raw})) END"
    return _kdj(n, clipped, k, d, previous_j)


def kdj_strict(n: int = 9, k: int = 3, d: int = 3, previous_j: str | None = None) -> Block:
    """Full window; a flat range counts as position 0."""
    top, bottom = R.highest("high", n), R.lowest("low", n)
    return _kdj(n, f"{ratio_or(f'(close - {bottom})', f'({top} - {bottom})', 0.0)} * 100.0D", k, d, previous_j)


# --------------------------------------------------------------------------
# support, range, structure
# --------------------------------------------------------------------------

def support_needs(lookback: int = 20) -> list[R.Need]:
    return R.needs("min", "low", lookback, shift=1)


def support_columns(lookback: int = 20) -> dict[str, str]:
    floor = R.lowest("low", lookback, max(3, lookback // 3), shift=1)
    return {
        "previous_20d_low": floor,
        "close_to_previous_20d_low_pct": change_pct("close", floor),
        "low_to_previous_20d_low_pct": change_pct("low", floor),
    }


def range_needs(lookback: int = 60) -> list[R.Need]:
    return [*R.needs("max", "high", lookback), *R.needs("min", "low", lookback)]


def range_columns(lookback: int = 60) -> dict[str, str]:
    warmup = max(10, lookback // 3)
    top, bottom = R.highest("high", lookback, warmup), R.lowest("low", lookback, warmup)
    return {
        "range_60d_high": top,
        "range_60d_low": bottom,
        "range_60d_pct": change_pct(top, bottom),
        "close_position_60d_pct": f"{ratio(f'(close - {bottom})', f'({top} - {bottom})')} * 100.0D",
    }


def support_and_range(df: DataFrame, support_lookback: int = 20, range_lookback: int = 60) -> DataFrame:
    return _derive(
        df,
        [*support_needs(support_lookback), *range_needs(range_lookback)],
        {**support_columns(support_lookback), **range_columns(range_lookback)},
    )


def downtrend_needs(window: int = 20) -> list[R.Need]:
    return [n for shift in (0, window) for n in (*R.needs("max", "high", window, shift=shift), *R.needs("min", "low", window, shift=shift))]


def downtrend_flag(window: int = 20, high_ratio: float = 0.99, low_ratio: float = 0.97) -> str:
    """1 when both the highs and the lows of the last window fell clearly below the one before."""
    lower_highs = f"{R.highest('high', window)} < {R.highest('high', window, shift=window)} * {high_ratio}D"
    lower_lows = f"{R.lowest('low', window)} < {R.lowest('low', window, shift=window)} * {low_ratio}D"
    return as_flag(f"{lower_highs} AND {lower_lows}")


def downtrend(df: DataFrame, window: int = 20, name: str | None = None) -> DataFrame:
    return _derive(df, downtrend_needs(window), {name or f"b1_structure_downtrend_{window}": downtrend_flag(window)})


def low_volume_needs(window: int = 20) -> list[R.Need]:
    return [*R.needs("collect_list", "volume", window), *R.needs("count", "volume", window)]


def low_volume_column(window: int = 20) -> str:
    """How many of the last ``window`` volumes are at least today's, today included."""
    volumes = R.Need("collect_list", "volume", window).name
    seen = R.Need("count", "volume", window).name
    return f"CASE WHEN {seen} >= {window} THEN CAST(size(filter({volumes}, v -> v >= volume)) AS DOUBLE) END"


def low_volume_count(df: DataFrame, window: int = 20, name: str = "low_volume_count") -> DataFrame:
    return _derive(df, low_volume_needs(window), {name: low_volume_column(window)})


# --------------------------------------------------------------------------
# the indicator table
# --------------------------------------------------------------------------

INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
KERNELS: dict[str, Kernel] = {}


def kernel(name: str, sources: Iterable[str], columns: Iterable[str]):
    """Register a user indicator over one symbol's arrays; it runs in the pass that computes the recursive averages."""

    def add(fn):
        if name in KERNELS:
            raise ValueError(f"kernel already registered: {name}")
        KERNELS[name] = Kernel(name, tuple(sources), tuple(columns), fn)
        return fn

    return add


def indicator(name: str):
    """Register a user indicator: a DataFrame transform run after the built-in ones."""

    def add(fn):
        if name in INDICATORS:
            raise ValueError(f"indicator already registered: {name}")
        INDICATORS[name] = fn
        return fn

    return add


def indicator_block(
    ma_windows=MA_WINDOWS, volume_windows=VOLUME_WINDOWS, macd_params=(12, 26, 9), brick=(4, 6)
) -> Block:
    facts = Block(
        windows=[*KLINE_NEEDS, *average_needs(ma_windows), *volume_needs(volume_windows)],
        columns={**kline_columns(), **moving_average_columns(ma_windows), **volume_columns(volume_windows)},
    )
    return facts + macd(*macd_params) + renko(*brick) + z_trend()


def indicator_order(columns: Iterable[str], ma_windows=MA_WINDOWS, volume_windows=VOLUME_WINDOWS) -> list[str]:
    ordered = [*BASE_COLUMNS, *KLINE_COLUMNS, *[f"ma{w}" for w in ma_windows], "volume_ratio_prev1"]
    for w in volume_windows:
        ordered += [f"volume_ma{w}", f"volume_ratio_ma{w}"]
    ordered += ["macd_dif", "macd_dea", "macd_hist", "renko_value"]
    columns = list(columns)
    ordered = [c for c in ordered if c in columns]
    return ordered + [c for c in columns if c not in ordered]


def state_schema(bars: DataFrame) -> T.StructType:
    """Schema of the state of :func:`resume_indicators` for such bars."""
    tail = T.ArrayType(T.StructType([T.StructField("day", T.DateType()), T.StructField("bar", bars.schema)]))
    head = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("seen", T.LongType()), T.StructField("last", T.DateType())])
    return head.add("tail", tail).add("memory", MEMORY_TYPE)


def _lookback(block: Block) -> int:
    """How many earlier bars the windows of a block look at."""
    return max([n.size + n.shift for n in block.windows], default=1)


def resume_indicators(state: DataFrame | None, fresh: DataFrame, block: Block | None = None) -> tuple[DataFrame, DataFrame]:
    """(indicators of ``fresh`` bars, state after them): goes on where ``state`` ends, without reading older bars.

    A state has one row per symbol: how many bars it has seen, the last ones (as many as the widest window needs), and
    the last values of the recursive averages.  Work and reads are those of the fresh bars and the state, so a
    day costs a day however long the history is; steps of any size give what one pass over all bars gives.
    Without a state all bars are fresh.  Bars must be unique per symbol and day and later than what the state has
    seen; bars that change the past need a rebuild, and raise here.  ``fresh`` must have the same columns each time.

    Both results are stored tables.
    """
    block = block or indicator_block()
    fresh = materialize(fresh, "fresh-bars")
    if state is None:
        state = fresh.sparkSession.createDataFrame([], state_schema(fresh))
    symbols = fresh.select("symbol").distinct()
    known = state.join(symbols, "symbol", "left_semi")
    old = known.selectExpr("inline(tail)").select("bar.*")
    before = known.selectExpr("symbol", "seen - size(tail) AS _base", "last AS _last", "memory AS _memory")
    bars = fresh.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True))).join(before, "symbol", "left")
    bars = materialize(bars, "resumed-bars")
    late = bars.where("NOT _old AND date <= _last").select("symbol", "date").take(1)
    if late:
        raise ValueError(f"the bar of {late[0]['symbol']} on {late[0]['date']} is not later than the state; rebuild the table")
    parted = R.by_symbol(bars).withColumn(R.BAR, F.expr(f"row_number() OVER ({R.BY_SYMBOL_SQL}) + coalesce(_base, 0L)"))
    wide = R.detach(extend(R.attach(parted, block.windows), {**block.columns, **block.inputs}))
    wide = wide.where("NOT _old").drop("_old", "_base", "_last")
    wide = add_recursive(wide, block.steps, drop=set(block.inputs), memory="_memory")
    rows = materialize(extend(wide, block.after).drop(*block.scratch), "indicators")

    # A group is a symbol's tail and its fresh bars, both bounded by the calendar.
    tails = bars.groupBy("symbol").agg(
        F.expr("coalesce(max(_base), 0L) + count(1) AS seen"), F.max("date").alias("last"),
        F.expr(f"slice(sort_array(collect_list(struct(date AS day, struct({', '.join(f'`{c}`' for c in fresh.columns)}) AS bar)), false), 1, {_lookback(block)}) AS tail"))
    memories = rows.where("_memory IS NOT NULL").select("symbol", F.col("_memory").alias("memory"))
    moved = tails.join(memories, "symbol", "left").select("symbol", "seen", "last", "tail", "memory")
    after = state.join(symbols, "symbol", "left_anti").union(moved)
    return rows.drop("_memory"), materialize(after, "indicator-state")


def indicator_table(
    bars: DataFrame,
    *,
    start_date=None,
    end_date=None,
    ma_windows=MA_WINDOWS,
    volume_windows=VOLUME_WINDOWS,
    macd_params=(12, 26, 9),
    brick=(4, 6),
    extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    kernels: Iterable[Kernel] | None = None,
    bucketed: bool = False,
) -> DataFrame:
    """All reusable indicators in a fixed column order.

    User indicators are audited and get those of the settings that they name.  Kernels, by default the registered
    ones, share the pass over each symbol: their names are checked here and their values in the pass.
    The end date cuts bars before the windows run; the start date cuts rows
    afterwards so that early rows still see their full history.  ``bucketed`` bars come from a table in buckets of
    symbols, which all steps read as it lies, without an exchange.
    """
    df = bars if end_date is None else bars.filter(F.col("date") <= F.lit(end_date).cast("date"))
    kernels = list(KERNELS.values() if kernels is None else kernels)
    block = indicator_block(ma_windows, volume_windows, macd_params, brick)
    check_kernels(kernels, [*bars.columns, *block.columns, *block.after, *(c for s in block.steps for c in outputs(s))])
    df = run(df if bucketed else R.by_symbol(df), block + Block(steps=kernels), carry=bucketed)
    options = {"ma_windows": ma_windows, "volume_windows": volume_windows, "macd_params": macd_params, "brick": brick}
    df = apply_audited(df, INDICATORS if extra is None else extra, options)
    if start_date is not None:
        df = df.filter(F.col("date") >= F.lit(start_date).cast("date"))
    return df.select(*indicator_order(df.columns, ma_windows, volume_windows))
