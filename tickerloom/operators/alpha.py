"""Cross-sectional alpha probe: daily percentile ranks, score, top-N and benchmarks.

Symbol windows need the exchange by symbol.  Everything per trading day goes
through distributed ranks or partial aggregates, because one day holds a row of
every symbol and is not bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions import rolling as R
from tickerloom.functions.scalars import change_pct, extend, first_code, ratio, to_number
from tickerloom.operators import indicators as I
from tickerloom.operators.cleaning import date_range, enough_history, selected_rows
from tickerloom.operators.labels import close_labels
from tickerloom.operators.grid import correlation_grid
from tickerloom.operators.ranking import medians, positions, ranks_in_place, value_positions
from tickerloom.scratch import materialize

# Score features (raw expression, weight), then ranks that are only probed.
SCORED = {
    "volatility_contract": ("-volatility20", 3.0),
    "pullback_ma20": ("-abs(close_to_ma20 - 1.03D)", 1.2),
    "cooldown_10d": ("-ret_10d_pct", 0.3),
}
PROBED = {"cooldown_3d": "-ret_3d_pct", "cooldown_5d": "-ret_5d_pct"}
RANKS = ["rank_volatility_contract", "rank_pullback_ma20", "rank_cooldown_10d", "rank_cooldown_3d", "rank_cooldown_5d"]
# Columns of the daily top table.
TOP_COLUMNS = [
    "date", "symbol", "alpha_rank", "alpha_score", "close", "ret_1d_pct", "ret_3d_pct", "ret_5d_pct", "ret_10d_pct",
    "ret_20d_pct", "excess_20d_pct", "close_to_ma20", "volatility20", "rank_volatility_contract", "rank_cooldown_10d",
    "rank_pullback_ma20", "rank_cooldown_3d", "rank_cooldown_5d",
]
SEED = 20260511


# --------------------------------------------------------------------------
# market panel
# --------------------------------------------------------------------------

def symbol_features(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Returns, averages, range position, volume ratio, volatility and close labels."""
    lags, averages = (1, 3, 5, 10, 20), (5, 10, 20, 60)
    df = R.attach(bars, [
        *R.needs("lag", "close", *lags), *R.needs("avg", "close", *averages), *R.needs("max", "high", 20),
        *R.needs("min", "low", 20), *R.needs("avg", "volume", 20),
    ])
    cols = {"trade_index": R.BAR}
    cols.update({f"ret_{k}d_pct": change_pct("close", R.previous("close", k)) for k in lags})
    cols.update({f"ma{w}": R.mean("close", w) for w in averages})
    cols.update({f"close_to_ma{w}": ratio("close", R.mean("close", w)) for w in averages})
    top, bottom = R.highest("high", 20), R.lowest("low", 20)
    cols.update({
        "high20": top, "low20": bottom,
        "close_pos20": ratio(f"(close - {bottom})", f"({top} - {bottom})"),
        "volume_ma20": R.mean("volume", 20),
        "volume_ratio20": ratio("volume", R.mean("volume", 20)),
    })
    df = R.detach(extend(df, cols))
    df = R.attach(df, R.needs("stddev_samp", "ret_1d_pct", 20))
    df = R.detach(extend(df, {"volatility20": R.deviation("ret_1d_pct", 20)}))
    return close_labels(df, horizons)


def market_panel(bars: DataFrame, horizons: Sequence[int] = (1, 2, 3), only_main_board: bool = False) -> DataFrame:
    """Features of symbols with enough history, and excess returns over the daily mean.

    ``only_main_board`` drops other symbols first, so means and later ranks do not see
    them.  Features are stored once for the mean and for the rows.  The daily mean
    has one row per calendar day, which bounds the broadcast.
    """
    if only_main_board:
        bars = bars.filter(F.substring(first_code("symbol"), 1, 2).isin("00", "60"))
    df = materialize(symbol_features(enough_history(R.by_symbol(bars), horizons), horizons), "features")
    market = df.groupBy("date").agg(F.avg("ret_1d_pct").alias("market_ret_1d_pct"))
    df = df.join(F.broadcast(market), "date")
    df = extend(df, {"excess_1d_pct": "ret_1d_pct - market_ret_1d_pct"})
    df = R.attach(df, R.needs("sum", "excess_1d_pct", 5, 20))
    return R.detach(extend(df, {
        "excess_5d_pct": R.total("excess_1d_pct", 5), "excess_20d_pct": R.total("excess_1d_pct", 20),
    }))


def merge_indicators(panel: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join of cached columns; colliding names get ``_ind``."""
    names = [c for c in cache.columns if c not in ("date", "symbol")]
    renamed = {c: f"{c}_ind" for c in names if c in panel.columns}
    out = panel.join(cache.withColumnsRenamed(renamed), ["date", "symbol"], "left")
    source = to_number("daily_return_pct_ind") if "daily_return_pct_ind" in out.columns else F.col("ret_1d_pct")
    return out.withColumn("daily_return_pct_project", source)


# --------------------------------------------------------------------------
# ranks, score, top-N
# --------------------------------------------------------------------------

def daily_pct_rank(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Percentile rank within each date for several columns; ``features`` maps output to input.

    Rows are ranked where they are sorted; nothing is joined on a value.
    """
    names = list(features)
    pairs = ", ".join(f"struct({i} AS _f, CAST({features[n]} AS DOUBLE) AS _v)" for i, n in enumerate(names))
    long = df.select("date", "symbol", F.expr(f"inline(array({pairs}))")).filter("_v IS NOT NULL")
    ranked = ranks_in_place(long, ["date", "_f"], "_v", "symbol", ["1"], keep=["symbol"])
    placed = ranked.selectExpr("date", "symbol", "_f", "(ranks[0].before + (ranks[0].ties + 1) / 2.0D) / ranks[0].total AS _pct")
    wide = placed.groupBy("date", "symbol").agg(*[
        F.expr(f"max(CASE WHEN _f = {i} THEN _pct END) AS {n}") for i, n in enumerate(names)
    ])
    return df.join(wide, ["date", "symbol"], "left")


def alpha_score(panel: DataFrame) -> DataFrame:
    """Weighted mean of the available ranks, times 100.  Ranks cover the whole panel."""
    raw = {f"raw_{n}": e for n, (e, _) in SCORED.items()}
    raw.update({f"raw_{n}": e for n, e in PROBED.items()})
    df = materialize(extend(panel, raw), "panel")
    df = daily_pct_rank(df, {f"rank_{n}": f"raw_{n}" for n in (*SCORED, *PROBED)})
    total = " + ".join(f"coalesce(rank_{n}, 0.0D) * {w}D" for n, (_, w) in SCORED.items())
    weight = " + ".join(f"CASE WHEN rank_{n} IS NOT NULL THEN {w}D ELSE 0.0D END" for n, (_, w) in SCORED.items())
    return extend(df, {
        "alpha_score_weight": weight,
        "alpha_score": f"CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) * 100.0D END",
    })


def daily_top(scored: DataFrame, n: int = 10) -> DataFrame:
    """Best ``n`` rows per date by score, then symbol.

    The rank filter is pushed below the shuffle: each task forwards at most ``n``
    rows per date.
    """
    best = Window.partitionBy("date").orderBy(F.desc("alpha_score"), "symbol")
    return scored.withColumn("alpha_rank", F.row_number().over(best)).filter(F.col("alpha_rank") <= n)


def formal_union(pools: dict[str, DataFrame], start_date=None, end_date=None) -> DataFrame:
    """Distinct (date, symbol, pool name) of several formal pools."""
    out = None
    for name, df in pools.items():
        code = next((c for c in ("symbol", "code") if c in df.columns), None)
        if code is None or "date" not in df.columns:
            continue
        part = date_range(selected_rows(df, positive=True), start_date, end_date).select(
            F.col("date").cast("date").alias("date"), first_code(code).alias("symbol"),
            F.lit(name.replace("_pool", "")).alias("formal_pool_name"),
        ).filter("date IS NOT NULL AND symbol != ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return SparkSession.active().createDataFrame([], "date date, symbol string, formal_pool_name string")
    return out.distinct()


def flag_members(scored: DataFrame, top: DataFrame, formal: DataFrame) -> DataFrame:
    def mark(keys: DataFrame, name: str) -> DataFrame:
        return keys.select("date", "symbol").distinct().withColumn(name, F.lit(1))

    df = scored.join(mark(top, "in_alpha_top"), ["date", "symbol"], "left")
    df = df.join(mark(formal, "in_formal_union"), ["date", "symbol"], "left")
    return df.fillna(0, ["in_alpha_top", "in_formal_union"])


# --------------------------------------------------------------------------
# daily statistics
# --------------------------------------------------------------------------

GROUPS = {"alpha_top": "in_alpha_top = 1", "market": "true", "formal_union": "in_formal_union = 1"}


def horizon_rows(df: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """(date, horizon, return) rows with a return."""
    pairs = ", ".join(f"struct('T{h}' AS horizon, ret_T{h} AS ret)" for h in horizons)
    return df.select("date", "symbol", *keep, F.expr(f"inline(array({pairs}))")).filter("ret IS NOT NULL")


def random_benchmark(rows: DataFrame, top_n: int = 10, trials: int = 200, seed: int = SEED) -> DataFrame:
    """Mean and spread of ``trials`` random ``top_n`` samples without replacement, per (date, horizon).

    Rows are numbered within their group; a trial then only draws numbers.  For
    the k-th draw a hash picks a number among the first n - N + k; if the trial
    has it already, n - N + k itself is taken, which makes every N-subset equally
    likely.  Work is rows + trials x N, not rows x trials, and the hash makes the
    draws reproducible anywhere.
    """
    keys = ["date", "horizon"]
    numbered = materialize(
        positions(rows.select(*keys, "symbol", "ret"), keys, ["symbol"]).select(*keys, "ret", F.col("_dense").alias("no"), F.col("_total").alias("n")),
        "numbered",
    )
    sizes = numbered.groupBy(*keys).agg(F.max("n").alias("n"))
    # The hashes are made before an exchange, so that they are compiled code and
    # the interpreted fold after it reads them instead of recomputing them.
    text = "concat('{seed}|', CAST(date AS STRING), '|', horizon, '|', trial, '|', {k})"
    hashes = ", ".join(
        f"CAST(conv(substr(md5({text.format(seed=seed, k=k)}), 1, 12), 16, 10) AS BIGINT)" for k in range(1, top_n + 1)
    )
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = sizes.repartition(slices, *keys).select(
        *keys, F.least(F.lit(top_n), F.col("n")).alias("size"), "n", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")
    )
    draws = draws.select("*", F.expr(f"array({hashes}) AS picks")).repartition(slices, *keys, "trial")
    last, pick = "(n - size + k)", "(picks[CAST(k AS INT) - 1] % (n - size + k) + 1)"
    draws = draws.select(*keys, "trial", "size", F.expr(
        f"aggregate(sequence(1L, CAST(size AS BIGINT)), CAST(array() AS ARRAY<BIGINT>), (got, k) ->"
        f" array_append(got, CASE WHEN array_contains(got, {pick}) THEN {last} ELSE {pick} END))"
    ).alias("nos"))
    # The outer form keeps the optimizer from pushing a size(nos) filter, and with it the fold, below the exchange.
    drawn = draws.select(*keys, "trial", "size", F.explode_outer("nos").alias("no")).join(numbered.drop("n"), [*keys, "no"])
    means = drawn.groupBy(*keys, "trial").agg(F.avg("ret").alias("m"), F.max("size").alias("size"))
    return means.groupBy(*keys).agg(
        F.max("size").cast("bigint").alias("random_count"),
        (F.avg("m") * 100.0).alias("random_avg_return_pct"),
        F.expr("stddev_pop(m * 100.0D) AS random_std_return_pct"),
    )


def daily_stats(
    scored: DataFrame,
    top: DataFrame,
    formal: DataFrame,
    *,
    horizons: Sequence[int] = (1, 2, 3),
    top_n: int = 10,
    trials: int = 200,
    seed: int = SEED,
) -> DataFrame:
    """Top-N against market, random picks and formal pools per (date, horizon)."""
    flagged = flag_members(scored, top, formal)
    rows = materialize(horizon_rows(flagged, horizons, ["in_alpha_top", "in_formal_union"]), "horizons")
    aggs, values = [], {}
    for g, cond in GROUPS.items():
        value = f"CASE WHEN {cond} THEN ret END"
        aggs += [
            F.expr(f"count({value}) AS {g}_count"),
            F.expr(f"count_if({cond} AND ret > 0) AS {g}_up_count"),
            F.expr(f"avg({value}) * 100.0D AS {g}_avg_return_pct"),
        ]
        values[f"_{g}"] = value
    keys = ["date", "horizon"]
    stats = rows.groupBy(*keys).agg(*aggs)
    mid = medians(extend(rows, values), keys, {f"{g}_median": f"_{g}" for g in GROUPS})
    # Dates whose rows all lack a return still get a line with zero counts.
    dates = scored.select("date").distinct()
    grid = dates.select("date", F.explode(F.array(*[F.lit(f"T{h}") for h in horizons])).alias("horizon"))
    df = grid.join(stats, keys, "left").join(mid, keys, "left").join(random_benchmark(rows, top_n, trials, seed), keys, "left")
    counts = [f"{g}_{c}" for g in GROUPS for c in ("count", "up_count")]
    df = df.fillna(0, [*counts, "random_count"])
    df = extend(df, {
        "month": "date_format(date, 'yyyy-MM')",
        **{f"{g}_up_ratio": f"try_divide({g}_up_count, {g}_count)" for g in GROUPS},
        **{f"{g}_median_return_pct": f"{g}_median * 100.0D" for g in GROUPS},
    })
    df = extend(df, {
        "excess_vs_market_pct": "alpha_top_avg_return_pct - market_avg_return_pct",
        "excess_vs_random_pct": "alpha_top_avg_return_pct - random_avg_return_pct",
        "excess_vs_formal_union_pct": "alpha_top_avg_return_pct - formal_union_avg_return_pct",
        "excess_up_ratio_vs_market": "alpha_top_up_ratio - market_up_ratio",
    })
    order = ["date", "month", "horizon"]
    order += [f"alpha_top_{c}" for c in ("count", "up_count", "up_ratio", "avg_return_pct", "median_return_pct")]
    order += [f"market_{c}" for c in ("count", "up_count", "up_ratio", "avg_return_pct", "median_return_pct")]
    order += ["random_count", "random_avg_return_pct", "random_std_return_pct"]
    order += [f"formal_union_{c}" for c in ("count", "up_count", "up_ratio", "avg_return_pct", "median_return_pct")]
    order += ["excess_vs_market_pct", "excess_vs_random_pct", "excess_vs_formal_union_pct", "excess_up_ratio_vs_market"]
    return df.select(*order)


MEANS = [
    "alpha_top_avg_return_pct", "market_avg_return_pct", "random_avg_return_pct", "formal_union_avg_return_pct",
    "excess_vs_market_pct", "excess_vs_random_pct", "excess_vs_formal_union_pct",
]


def monthly_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy("month", "horizon").agg(
        F.count(F.lit(1)).alias("trading_days"),
        *[F.avg(c).alias(c) for c in MEANS],
        F.expr("count_if(excess_vs_market_pct > 0) AS positive_excess_days"),
        F.count("excess_vs_market_pct").alias("valid_excess_days"),
        F.expr("try_divide(count_if(excess_vs_market_pct > 0), count(excess_vs_market_pct)) AS positive_excess_day_ratio"),
    )


def rank_ic(scored: DataFrame, horizons: Sequence[int] = (1, 2, 3), least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(daily IC of the score, daily IC of every feature) as Spearman correlations.

    A date below ``least`` rows gets a row without IC and no feature rows.  Each return is sorted once
    for all features and each feature once for all returns.
    """
    features, returns = ["alpha_score", *RANKS], {f"ret_T{h}": f"T{h}" for h in horizons}
    keys = ["date", "horizon"]
    ics = correlation_grid(scored.filter("alpha_score IS NOT NULL"), ["date"], features, list(returns), least=max(2, least))
    horizon = "CASE target_col " + " ".join(f"WHEN '{c}' THEN '{h}'" for c, h in returns.items()) + " END AS horizon"
    every = materialize(ics.selectExpr(
        "date", "date_format(date, 'yyyy-MM') AS month", horizon, "factor AS feature", "n AS count", "spearman_ic AS rank_ic"), "ics")
    grid = scored.select("date").distinct().select(
        "date", F.date_format("date", "yyyy-MM").alias("month"), F.explode(F.array(*[F.lit(f"T{h}") for h in horizons])).alias("horizon"))
    score = grid.join(every.filter("feature = 'alpha_score'").drop("feature", "month"), keys, "left").fillna(0, ["count"])
    enough = score.filter(F.col("count") >= least).select(*keys)
    # (date, horizon) pairs: bounded by the calendar times the horizon list.
    return score, every.join(F.broadcast(enough), keys, "left_semi")


def alpha_summary(daily: DataFrame, monthly: DataFrame, ic: DataFrame) -> DataFrame:
    """One row per horizon over the daily, monthly and IC tables."""
    names = {
        "avg_alpha_top_return_pct": "alpha_top_avg_return_pct", "avg_market_return_pct": "market_avg_return_pct",
        "avg_random_return_pct": "random_avg_return_pct", "avg_formal_union_return_pct": "formal_union_avg_return_pct",
        "avg_excess_vs_market_pct": "excess_vs_market_pct", "avg_excess_vs_random_pct": "excess_vs_random_pct",
        "avg_excess_vs_formal_union_pct": "excess_vs_formal_union_pct",
    }
    positive = "avg(CASE WHEN {0} > 0 THEN 1.0D WHEN {0} <= 0 THEN 0.0D END)"
    d = daily.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("daily_rows"), *[F.avg(c).alias(n) for n, c in names.items()],
        F.expr(positive.format("excess_vs_market_pct") + " AS positive_excess_day_ratio"),
    )
    m = monthly.groupBy("horizon").agg(F.expr(positive.format("excess_vs_market_pct") + " AS positive_excess_month_ratio"))
    i = ic.groupBy("horizon").agg(
        F.avg("rank_ic").alias("avg_rank_ic"), F.expr(positive.format("rank_ic") + " AS positive_rank_ic_ratio"))
    mid = medians(ic, ["horizon"], {"median_rank_ic": "rank_ic"})
    # One row per horizon in every table.
    for part in (m, i, mid):
        d = d.join(F.broadcast(part), "horizon", "left")
    return d
