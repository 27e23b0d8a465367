"""Pool assembly, schema normalization, refresh and enrichment."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import rolling as R
from tickerloom.functions.recursive import outputs
from tickerloom.functions.scalars import change_pct, extend, first_code, normalize_symbol, safe_div, to_number
from tickerloom.operators import indicators as I
from tickerloom.operators.cleaning import clean_bars, date_range, keep_last
from tickerloom.operators.contract import FORBIDDEN, pool_checks
from tickerloom.operators.labels import forward_columns, label_columns, next_bars
from tickerloom.operators.ranking import quantiles
from tickerloom.operators.strategies import B2_FROM_B1, B2_INLINE, get_strategy
from tickerloom.scratch import materialize_checked

# Column order of a saved pool.
CORE_COLUMNS = ["symbol", "file", "date", "selection_strategy"]
PRICE_COLUMNS = [
    "open", "high", "low", "close", "volume", "amount", "prev_close", "prev_volume", "daily_return_pct",
    "intraday_return_pct", "amplitude_pct", "upper_shadow_pct", "lower_shadow_pct", "body_pct", "body_abs_pct",
    "upper_shadow_ratio", "is_red_k", "is_green_k", "is_flat_k",
]
COMMON_COLUMNS = [
    "ma5", "ma10", "ma20", "ma50", "ma60", "volume_ma5", "volume_ratio_ma5", "volume_ma10", "volume_ratio_ma10",
    "volume_ratio_prev1", "macd_dif", "macd_dea", "macd_hist", "kdj_k", "kdj_d", "kdj_j", "j",
]
# Raw lines and helper columns that a final pool drops.
DROPPED_COLUMNS = {"z_short_trend_line", "z_long_trend_line", "renko_ref1", "renko_ref2"}
TEXT_COLUMNS = {
    "symbol", "file", "selection_strategy", "risk_tags", "j_condition_rule", "j_condition_source_col",
    "v4_hint_label", "forward_data_status", "b1_source_strategy",
}
# Columns a stored indicator table must have.
INDICATOR_CACHE_REQUIRED = [
    "symbol", "file", "date", "open", "high", "low", "close", "volume", "amount",
    "daily_return_pct", "intraday_return_pct", "amplitude_pct", "upper_shadow_pct", "lower_shadow_pct",
    "body_pct", "body_abs_pct", "ma5", "ma10", "ma20", "ma60", "volume_ma5", "volume_ma10",
    "volume_ratio_ma5", "volume_ratio_ma10", "volume_ratio_prev1", "macd_dif", "macd_dea", "macd_hist",
]
# Names of versioned and obsolete pool columns.
VERSIONED = re.compile(r"^b2v\d+_(.+)$")
OBSOLETE_SCORE = re.compile(r"^b2v\d+_(bucket_|score_(?!rank_key$|pct$))")
REFRESH_DAYS = 45


# --------------------------------------------------------------------------
# columns of a pool row
# --------------------------------------------------------------------------

def trend_distance(df: DataFrame) -> DataFrame:
    """Close relative to both trend lines; the comparison flag needs both lines."""
    have = set(df.columns)
    lines = ("z_short_trend_line", "z_long_trend_line")
    out = {f"t0_close_to_{x}_pct": change_pct("close", x) if x in have else "CAST(NULL AS DOUBLE)" for x in lines}
    if set(lines) <= have:
        out["z_short_trend_above_z_long_trend_line"] = f"CAST({lines[0]} > {lines[1]} AS INT)"
    return extend(df, out)


def entry_gap(df: DataFrame) -> DataFrame:
    """Gap from the signal close to the executable T+1 open."""
    if "t1_open_gap_pct" in df.columns or not {"t1_open", "close"} <= set(df.columns):
        return df
    gap = F.when(F.col("close") > 0, (safe_div("t1_open", "close") - 1.0) * 100.0)
    return df.withColumn("t1_open_gap_pct", gap)


def attach_identity(df: DataFrame, strategy_name: str, fallback_symbol: str = "", fallback_file: str | None = None) -> DataFrame:
    """Symbol, source file and strategy name, each filled only where missing."""
    fallback = normalize_symbol(F.lit(fallback_symbol))
    code = normalize_symbol("symbol") if "symbol" in df.columns else F.lit("")
    df = df.withColumn("symbol", F.when(code == "", fallback).otherwise(code))
    if "file" not in df.columns:
        df = df.withColumn("file", F.lit(fallback_file).cast("string"))
    if "selection_strategy" not in df.columns:
        df = df.withColumn("selection_strategy", F.lit(strategy_name))
    return df


def rehydrate(pool: DataFrame, table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bring back indicator columns a strategy dropped, by (symbol, date)."""
    wanted = [c for c in (columns or table.columns) if c in table.columns and c not in pool.columns]
    if not wanted:
        return pool
    return pool.join(table.select("symbol", "date", *wanted), ["symbol", "date"], "left")


def normalize_schema(pool: DataFrame, drop_forward: bool = False) -> DataFrame:
    """Final names, types and order of pool columns, in one projection.

    Versioned duplicates (``b2v3_x``) fill gaps of ``x`` and disappear; old
    scores and raw trend lines are dropped; text columns become numbers if any
    value parses.
    """
    names = [c for c in pool.columns if not OBSOLETE_SCORE.match(c)]
    merged: dict[str, list[str]] = {}
    for c in names:
        versioned = VERSIONED.match(c)
        target = versioned.group(1) if versioned else c
        if versioned:
            merged.setdefault(target, []).append(c)
        else:
            merged.setdefault(target, []).insert(0, c)
    dropped = DROPPED_COLUMNS | set(FORBIDDEN) | (set(forward_columns()) if drop_forward else set())
    merged = {t: cs for t, cs in merged.items() if t not in dropped}

    kinds = {f.name: f.dataType for f in pool.schema.fields}
    text = [
        t for t, cs in merged.items()
        if t not in TEXT_COLUMNS and not t.endswith("_date") and t != "date"
        and all(isinstance(kinds[c], T.StringType) for c in cs)
    ]
    parses: dict[str, bool] = {}
    if text:
        seen = pool.agg(*[
            ((F.count(to_number(F.coalesce(*merged[t]))) > 0) | (F.count(F.coalesce(*merged[t])) == 0)).alias(t) for t in text
        ]).first()
        parses = {t: bool(seen[t]) for t in text}

    def build(t: str):
        sources = merged[t]
        kind = kinds[sources[0]]
        if t == "symbol":
            return normalize_symbol(t).alias(t)
        if (t == "date" or t.endswith("_date")) and not isinstance(kind, T.DateType):
            cast = "try_cast" if isinstance(kind, T.StringType) else "cast"
            return F.expr(f"{cast}(coalesce({', '.join(f'`{x}`' for x in sources)}) AS DATE) AS `{t}`")
        if parses.get(t):
            return to_number(F.coalesce(*[F.col(f"`{x}`") for x in sources])).alias(t)
        if sources == [t]:
            return t
        return F.expr(f"coalesce({', '.join(f'`{x}`' for x in sources)}) AS `{t}`")

    front = [c for c in [*CORE_COLUMNS, *PRICE_COLUMNS, *COMMON_COLUMNS, *forward_columns()] if c in merged]
    return pool.select(*[build(t) for t in [*front, *[t for t in merged if t not in front]]])


def build_pool(
    bars: DataFrame,
    strategy_name: str,
    *,
    start_date=None,
    end_date=None,
    validate: bool = True,
    with_range: bool = False,
    order: Sequence[str] | None = None,
    **params,
) -> DataFrame:
    """Bars to pool rows: cleaning, indicators, selection, trend distance, labels, schema.

    Symbols become six-digit codes and invalid bars go.  ``order`` names the columns
    that say which of several bars of one symbol and day came last; without it
    bars must be unique.  Labels and strategies see complete history; the
    window is cut at the end.  With ``validate`` the rows are stored once, checked on the way.
    """
    rule = get_strategy(strategy_name)
    coded = bars.withColumn("symbol", F.coalesce(F.nullif(first_code("symbol"), F.lit("")), F.col("symbol")))
    df = date_range(clean_bars(coded, "cache", order=order), None, end_date)
    # The pool-driven rule partitions by symbol itself, after it has dropped symbols.
    df = rule.prepare(df if strategy_name == B2_FROM_B1 else R.by_symbol(df), **params)
    block = I.Block(columns=next_bars(with_range=with_range))
    if strategy_name != B2_FROM_B1:
        block = block + I.indicator_block()
    known = set(df.columns) | set(block.columns) | {c for s in block.steps for c in outputs(s)}
    # The inline rule filters on most of its windows, so they travel with the bars in the one exchange.
    df = I.run(df, block + rule.block(known, **params), carry=strategy_name == B2_INLINE)
    df = label_columns(rule.finish(df, **params), with_range=with_range)
    df = date_range(df, start_date)
    df = normalize_schema(attach_identity(trend_distance(df), strategy_name))
    return checked_pool(df, strategy_name) if validate and not with_range else df


def checked_pool(pool: DataFrame, strategy_name: str) -> DataFrame:
    """The pool, stored; the contract is checked by the job that stores it."""
    checks = pool_checks(pool, strategy_name)
    stored, seen = materialize_checked(pool, "pool", checks.metrics)
    checks.judge(seen)
    return stored


# --------------------------------------------------------------------------
# calendar, build window, preflight
# --------------------------------------------------------------------------

def calendar(bars: DataFrame) -> DataFrame:
    """Distinct trading dates: one row per calendar day at most."""
    return bars.select(F.col("date").cast("date").alias("date")).filter("date is not null").distinct()


@dataclass(frozen=True)
class DateSpan:
    """First and last date of a table, and its number of rows with a date."""

    first: dt.date | None
    last: dt.date | None
    rows: int


def _span(df: DataFrame) -> DateSpan:
    row = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("date").alias("n")).first()
    return DateSpan(_day(row["lo"]), _day(row["hi"]), row["n"])


@dataclass(frozen=True)
class BuildWindow:
    #: full_build, incremental_explicit_start, incremental_refresh_window, incremental_no_existing_pool_full_build.
    mode: str
    start: dt.date | None
    end: dt.date
    market_min: dt.date
    market_max: dt.date
    old_pool_min: dt.date | None
    old_pool_max: dt.date | None
    old_pool_rows: int
    trading_dates: int


def _day(x) -> dt.date | None:
    if x is None or isinstance(x, dt.date) and not isinstance(x, dt.datetime):
        return x
    return x.date() if isinstance(x, dt.datetime) else dt.date.fromisoformat(str(x)[:10])


def _end_date_problem(dates: DataFrame, wanted: dt.date, table: str) -> str | None:
    day = F.lit(wanted).cast("date")
    row = dates.agg(
        F.max("date").alias("latest"),
        F.max(F.when(F.col("date") < day, F.col("date"))).alias("before"),
        F.min(F.when(F.col("date") > day, F.col("date"))).alias("after"),
        F.count(F.when(F.col("date") == day, 1)).alias("hit"),
    ).first()
    if row["latest"] is None:
        return f"no usable date in {table}"
    if wanted > row["latest"]:
        return f"{table} ends on {row['latest']}, too early for {wanted}"
    if not row["hit"]:
        return f"{wanted} is no trading day of {table}; the days beside it are {row['before']} and {row['after']}"
    return None


def resolve_window(
    bars: DataFrame,
    old_pool: DataFrame | None = None,
    *,
    start_date=None,
    end_date=None,
    incremental: bool = False,
    refresh_days: int = REFRESH_DAYS,
    market: DateSpan | None = None,
    old: DateSpan | None = None,
) -> BuildWindow:
    """Which dates a build covers, checked against the trading calendar.

    ``market`` and ``old`` are the spans of the bars and the old pool where they are known, say from file footers;
    else one aggregate finds each.  The calendar inside the window is read in any case.
    """
    dates = calendar(bars)
    market = market or _span(dates)
    if market.last is None:
        raise RuntimeError("the bar table holds no trading day to build from")
    start, end = _day(start_date), _day(end_date) or market.last
    if end_date is not None:
        problem = _end_date_problem(dates, end, "the bar table")
        if problem:
            raise RuntimeError(problem)
    if old is None and old_pool is not None:
        old = _span(old_pool)
    old = old or DateSpan(None, None, 0)
    mode = "full_build"
    if incremental and start is not None:
        mode = "incremental_explicit_start"
    elif incremental and old.last is not None:
        mode, start = "incremental_refresh_window", old.last - dt.timedelta(days=int(refresh_days))
    elif incremental:
        mode, start = "incremental_no_existing_pool_full_build", market.first
    if start is not None and start > end:
        raise RuntimeError(f"the window starts after its end: {start} > {end}")
    inside = date_range(dates, start, end).count()
    if inside == 0:
        raise RuntimeError(f"no trading day between {start} and {end}")
    return BuildWindow(mode, start, end, market.first, market.last, old.first, old.last, old.rows, inside)


def preflight(bars: DataFrame, indicators: DataFrame, window: BuildWindow, strategy_name: str) -> None:
    """Fail early when the indicator cache lacks columns or dates the build needs."""
    need = [*INDICATOR_CACHE_REQUIRED, *(["renko_value"] if "renko" in strategy_name.lower() else [])]
    missing = [c for c in need if c not in indicators.columns]
    if missing:
        raise RuntimeError(f"the indicator table lacks {missing}")
    for table, df in (("the bar table", bars), ("the indicator table", indicators)):
        problem = _end_date_problem(calendar(df), window.end, table)
        if problem:
            raise RuntimeError(problem)


# --------------------------------------------------------------------------
# refresh, enrichment, summaries
# --------------------------------------------------------------------------

def merge_window(old: DataFrame, new: DataFrame, start, end) -> DataFrame:
    """Old rows outside [start, end] plus all new rows, new winning on equal keys."""
    day = F.col("date").cast("date")
    inside = day.between(F.lit(_day(start)), F.lit(_day(end)))
    kept = old.filter(~F.coalesce(inside, F.lit(True))).withColumn("_age", F.lit(0))
    merged = kept.unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return keep_last(merged, ["symbol", "date", "selection_strategy"], ["_age"]).drop("_age")


def merge_report(old: DataFrame, new: DataFrame, final: DataFrame, start, end) -> DataFrame:
    inside = F.col("date").between(F.lit(_day(start)), F.lit(_day(end)))
    tagged = (
        old.select(F.lit("old").alias("src"), inside.alias("inside"))
        .unionByName(new.select(F.lit("new").alias("src"), F.lit(None).cast("boolean").alias("inside")))
        .unionByName(final.select(F.lit("final").alias("src"), F.lit(None).cast("boolean").alias("inside")))
    )

    def rows(src: str):
        return F.count(F.when(F.col("src") == src, 1))

    wide = tagged.agg(
        rows("old").alias("old_rows"),
        F.count(F.when(F.col("inside"), 1)).alias("removed_old_rows"),
        rows("new").alias("new_rows"),
        rows("final").alias("final_rows"),
    )
    return wide.select(
        F.lit("incremental_merge").alias("mode"),
        F.lit(_day(start)).alias("replace_start"),
        F.lit(_day(end)).alias("replace_end"),
        "old_rows",
        "removed_old_rows",
        "new_rows",
        (F.col("old_rows") - F.col("removed_old_rows") + F.col("new_rows") - F.col("final_rows")).alias("dropped_duplicate_rows"),
        "final_rows",
    )


def enrich_downtrend(pool: DataFrame, bars: DataFrame, window: int = 40) -> DataFrame:
    """(Re)compute the longer structural downtrend flag of every pool row; unknown rows get 0."""
    name = f"b1_structure_downtrend_{window}"
    known = bars.filter("high is not null and low is not null").select(first_code("symbol").alias("symbol"), "date", "high", "low")
    # Bars of symbols outside the pool are dropped before any window.
    coded = pool.drop(name).withColumn("_code", first_code("symbol"))
    known = known.join(coded.select(F.col("_code").alias("symbol")).distinct(), "symbol", "left_semi")
    factor = I.downtrend(known, window, name).select(F.col("symbol").alias("_code"), F.col("date").alias("_day"), name)
    out = coded.join(factor, (F.col("date") == F.col("_day")) & coded["_code"].eqNullSafe(factor["_code"]), "left")
    return out.select(*[c for c in pool.columns if c != name], F.coalesce(name, F.lit(0)).alias(name))


def pool_summary(pool: DataFrame) -> DataFrame:
    """Rows, symbols, dates and date range of a pool."""
    return pool.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("symbol").alias("symbols"),
        F.countDistinct("date").alias("dates"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )


def daily_counts(pool: DataFrame, last: int | None = None) -> DataFrame:
    """Rows per date; ``last`` keeps only the most recent dates, as a report does."""
    out = pool.groupBy("date").agg(F.count(F.lit(1)).alias("pool_count"))
    return out.orderBy(F.desc("date")).limit(last) if last else out


def status_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("forward_data_status").agg(F.count(F.lit(1)).alias("rows"))


def unpivot_targets(pool: DataFrame, targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per pool row and target that has a value."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target_col"), F.col(t).cast("double").alias("target_value")) for t in targets])
    long = pool.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")
    value = F.col("target_value")
    return long.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def describe_returns(pool: DataFrame, targets: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max and up ratio of each return column."""
    long = unpivot_targets(pool, targets)
    y = F.col("target_value")
    basic = long.groupBy("target_col").agg(
        F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"), F.max(y).alias("max"), F.avg((y > 0).cast("double")).alias("up_ratio"),
    )
    cuts = quantiles(long, ["target_col"], "target_value", {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4)})
    return basic.join(F.broadcast(cuts), "target_col")


def daily_with_index(pool: DataFrame, index: DataFrame) -> DataFrame:
    """Daily pool counts beside the index close and return of the same dates."""
    daily = daily_counts(pool)
    return daily.join(index.select("date", F.col("close").alias("index_close"), "index_return_pct"), "date", "left")
