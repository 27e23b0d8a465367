"""Factor detection and factor-by-target bucket analysis.

A scan of all factors and targets sorts each factor once for all targets and each target once
for all factors (``correlation_grid``), which gives correlations and exact cut
points.  Everything after that is aggregates over (factor, target, x, y) rows that
are never shuffled themselves.  Tables with a fixed number of rows per (factor,
target) are bounded by the number of pool columns and are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.scalars import extend, parse_boolean, to_number
from tickerloom.operators.contract import FUTURE_BAR
from tickerloom.operators.grid import correlation_grid
from tickerloom.operators.ranking import (
    medians,
    positions,
    quantile,
    rank_bucket,
    ranks_in_place,
    value_positions,
)
from tickerloom.scratch import materialize

SCHEMA_VERSION = "factor_shape_v15_t20_safe_full_factor_scan"
# Vote thresholds of information coefficients, returns and up ratios.
IC_EPS, RETURN_EPS, UP_EPS = 0.005, 0.05, 0.005

# Columns that are never factors in the direction analysis.
NON_FACTORS = {
    "date", "symbol", "code", "name", "stock_name", "selection_strategy", "selected", "selected_score_base",
    "score_rank_key", "score_pct", "renko_ref1", "renko_ref2", "prev_green_brick_len", "red_brick_len",
}
ABSOLUTE_LEVELS = {
    "amount", "close", "high", "low", "open", "short_trend", "t1_open", "tdx_long_trend_line",
    "tdx_short_trend_line", "trend_line", "volume", "z_long_trend_line", "z_short_trend_line",
}
NUMBERED_LEVEL = re.compile(r"^(ma|volume_ma|amount_ma)\d+$")
# Identifier columns carried into member detail, in order.
MEMBER_COLUMNS = [
    "date", "symbol", "code", "name", "stock_name", "selection_strategy", "selected", "selected_score_base",
    "score_rank_key", "score_pct", "close", "daily_return_pct", "market_regime", "v4_hint_label", "hint_label",
]
# Exclusions of the single-factor view.
SINGLE_FACTOR_EXCLUDED = {
    "date", "trade_date", "datetime", "symbol", "code", "ticker", "ts_code", "file", "selection_strategy",
    "selected", "selected_score_base", "score_rank_key", "open", "high", "low", "close", "volume", "amount",
}
SINGLE_FACTOR_PATTERNS = ("fwd", "forward", "future", "target", "next_", "t1_", "t2_", "t3_", "t4_")
# Exclusions of the refinement view, by name only.
REFINEMENT_EXCLUDED = {
    "symbol", "code", "file", "date", "selection_strategy", "risk_tags", "j_condition_rule",
    "j_condition_source_col", "v4_hint_label", "forward_data_status", "selected", "selected_score_base", "score",
    "score_rank_key", "score_pct",
}


# --------------------------------------------------------------------------
# which columns are factors
# --------------------------------------------------------------------------

def _is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def number_sql(name: str, kind: T.DataType) -> str:
    """A column as a finite DOUBLE: NaN and infinities become NULL."""
    if isinstance(kind, T.StringType):
        value = f"try_cast(trim(`{name}`) AS DOUBLE)"
    else:
        value = f"CAST(`{name}` AS DOUBLE)"
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value
    return f"CASE WHEN abs({value}) < double('inf') THEN {value} END"


def factor_columns(df: DataFrame, targets: Sequence[str] = (), wanted: Sequence[str] | None = None) -> list[str]:
    """Columns with at least 30% finite numbers and two distinct values.

    One aggregate decides for all columns; two distinct values exist exactly
    when the minimum and maximum differ.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def named_like_a_factor(c: str) -> bool:
        low = c.strip().lower()
        outside = c in NON_FACTORS or low in ABSOLUTE_LEVELS or NUMBERED_LEVEL.match(low) or FUTURE_BAR.match(low)
        label = c.startswith(("fwd_close_T", "fwd_return_pct_T", "fwd_up_T"))
        return not (outside or label or c in targets)

    names = [c for c in (wanted or df.columns) if c in kinds and named_like_a_factor(c)]
    names = [c for c in names if _is_numeric(kinds[c]) or isinstance(kinds[c], T.StringType)]
    if not names:
        return []
    checks = [F.count(F.lit(1)).alias("_rows")]
    for c in names:
        v = number_sql(c, kinds[c])
        checks.append(F.expr(f"struct(count({v}) AS n, min({v}) AS lo, max({v}) AS hi) AS `{c}`"))
    seen = df.agg(*checks).first()
    return [c for c in names if seen["_rows"] and seen[c]["n"] >= 0.3 * seen["_rows"] and seen[c]["lo"] != seen[c]["hi"]]


def refinement_factors(columns: Sequence[str]) -> list[str]:
    """Name-only choice for extreme-bucket refinement; future bars never qualify."""
    return [
        c for c in columns
        if c not in REFINEMENT_EXCLUDED and not c.startswith(("fwd_return_pct_", "fwd_up_"))
        and not c.endswith("_date") and not FUTURE_BAR.match(c.lower())
    ]


def factor_kinds(df: DataFrame) -> dict[str, str]:
    """``boolean`` or ``numeric`` for every usable column, from one aggregate.

    Boolean needs 90% of the non-missing values to read as true or false.
    """
    names = [
        c for c in df.columns
        if not c.lower().startswith("_") and c.lower() not in SINGLE_FACTOR_EXCLUDED
        and not any(p in c.lower() for p in SINGLE_FACTOR_PATTERNS)
    ]
    if not names:
        return {}
    seen = df.agg(*[
        F.struct(
            F.count(c).alias("n"),
            F.count(parse_boolean(c)).alias("flags"),
            F.count(to_number(F.col(c).cast("string"))).alias("numbers"),
        ).alias(c)
        for c in names
    ]).first()
    out = {}
    for c in sorted(names):
        s = seen[c]
        if s["n"] and s["flags"] > 0 and s["flags"] >= max(1, int(s["n"] * 0.9)):
            out[c] = "boolean"
        elif s["numbers"] > 0:
            out[c] = "numeric"
    return out


# --------------------------------------------------------------------------
# long form and buckets
# --------------------------------------------------------------------------

KEYS = ["factor", "target_col"]


def factor_target_rows(pool: DataFrame, factors: Sequence[str], targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(factor, target_col, x, y) rows where both values are finite."""
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    xs = ", ".join(f"struct('{f}' AS factor, {number_sql(f, kinds[f])} AS x)" for f in factors)
    ys = ", ".join(f"struct('{t}' AS target_col, {number_sql(t, kinds[t])} AS y)" for t in targets)
    wide = pool.select(*keep, F.expr(f"array({ys}) AS _ys"), F.expr(f"inline(array({xs}))")).filter("x IS NOT NULL")
    return wide.select(*keep, "factor", "x", F.expr("inline(_ys)")).filter("y IS NOT NULL")


def cut_points(rows: DataFrame, keys: Sequence[str], buckets: int, few_values: int | None = None) -> DataFrame:
    """Per group: ``edges`` of its quantile buckets, or ``levels`` when it has few distinct values.

    Few are at most ``few_values``, by default as many as buckets.
    """
    return cuts_of(value_positions(rows, keys, "x"), keys, buckets, few_values)


def cuts_of(spots: DataFrame, keys: Sequence[str], buckets: int, few_values: int | None = None) -> DataFrame:
    """:func:`cut_points` from rows of ``value_positions``."""
    few = F.max("_distinct") <= (buckets if few_values is None else few_values)
    return spots.groupBy(*keys).agg(
        F.max("_total").alias("sample_count"),
        F.max("_distinct").alias("distinct_count"),
        F.when(~few, F.array_distinct(F.array(*[quantile("x", k, buckets) for k in range(buckets + 1)]))).alias("edges"),
        F.when(few, F.array_sort(F.collect_list(F.when(F.col("_dense") <= buckets, F.col("x"))))).alias("levels"),
    )


def bucket_of(x: str = "x") -> Column:
    """1-based bucket of ``x`` given ``edges``/``levels``: intervals closed on the right."""
    return F.expr(
        f"CASE WHEN levels IS NOT NULL THEN size(filter(levels, v -> v <= {x}))"
        f" ELSE greatest(1, size(filter(edges, e -> e < {x}))) END"
    )


def value_buckets(rows: DataFrame, keys: Sequence[str], buckets: int, least: int = 0) -> DataFrame:
    """Rows with their quantile ``bucket``; groups below ``least`` rows or with one value are dropped."""
    cuts = cut_points(rows, keys, buckets).filter(
        (F.col("sample_count") >= least) & (F.col("distinct_count") >= 2)
    )
    # One row per (factor, target): bounded by the number of pool columns.
    return (
        rows.join(F.broadcast(cuts), list(keys))
        .withColumn("bucket", bucket_of())
        .drop("edges", "levels")
    )


def rank_buckets(rows: DataFrame, keys: Sequence[str], buckets: int, order: Sequence[str], name: str = "bucket", by_distinct: bool = False) -> DataFrame:
    """Equal-count buckets of the rank scale; ties are split in ``order``.

    With ``by_distinct`` there are never more buckets than distinct values.
    """
    q: Column | int = buckets
    if by_distinct:
        sizes = rows.groupBy(*keys, "x").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("_one").alias("_levels"))
        rows = rows.join(F.broadcast(sizes), list(keys))
        q = F.least(F.lit(buckets), F.greatest(F.col("_levels"), F.lit(1)))
    placed = positions(rows, keys, ["x", *order])
    out = placed.withColumn(name, rank_bucket(F.col("_dense"), F.col("_distinct"), q))
    return out.drop("_before", "_dense", "_total", "_distinct", "_levels")


def return_stats(y: str = "y", prefix: str = "") -> list[Column]:
    """Mean and win/loss figures of a target; a zero return is a loss."""
    return [
        F.expr(f"count({y}) AS {prefix}sample_count"),
        F.expr(f"avg({y}) AS {prefix}mean_return"),
        F.expr(f"avg(CASE WHEN {y} > 0 THEN 1.0D WHEN {y} <= 0 THEN 0.0D END) AS {prefix}up_ratio"),
        F.expr(f"count_if({y} > 0) AS {prefix}win_count"),
        F.expr(f"count_if({y} <= 0) AS {prefix}loss_count"),
    ]


DETAIL_COLUMNS = [
    "factor", "target_col", "bucket", "sample_count", "min_factor", "max_factor", "mean_factor", "mean_return",
    "median_return", "up_ratio", "win_count", "loss_count",
]


def bucket_detail(bucketed: DataFrame) -> DataFrame:
    """One row per (factor, target, bucket)."""
    keys = [*KEYS, "bucket"]
    stats = bucketed.groupBy(*keys).agg(
        F.min("x").alias("min_factor"), F.max("x").alias("max_factor"), F.avg("x").alias("mean_factor"), *return_stats()
    )
    # Both sides have one row per bucket: bounded by columns times bucket count.
    mid = medians(bucketed.select(*keys, "y"), keys, {"median_return": "y"})
    return stats.join(F.broadcast(mid), keys).select(*DETAIL_COLUMNS)


def bucket_members(pool: DataFrame, factors: Sequence[str], targets: Sequence[str], buckets: int = 10, least: int = 1000) -> DataFrame:
    """Every pool row of every (factor, target) with its bucket, identifier columns included."""
    labels = sorted((c for c in pool.columns if re.fullmatch(r"fwd_return_pct_T\d+", c)), key=lambda c: int(c.rsplit("T", 1)[1]))
    keep = [c for c in dict.fromkeys([*MEMBER_COLUMNS, *labels]) if c in pool.columns]
    rows = factor_target_rows(pool, factors, targets, keep)
    out = value_buckets(rows, KEYS, buckets, least)
    return out.select(
        "factor", "bucket", F.col("x").alias("factor_value"), "target_col", F.col("y").alias("target_value"), *keep
    )


def interval_view(detail: DataFrame, digits: int = 6) -> DataFrame:
    """Bucket table with a printable ``[low, high]`` interval."""
    scale = 10.0 ** digits
    ends = [F.floor(F.col(c) * scale + 0.5).cast("double") / scale for c in ("min_factor", "max_factor")]
    shown = F.when(
        F.col("min_factor").isNotNull() & F.col("max_factor").isNotNull(),
        F.format_string(f"[%.{digits}f, %.{digits}f]", *ends),
    ).otherwise("")
    return detail.withColumn("factor_interval", shown).select(
        *KEYS, "bucket", "factor_interval", "min_factor", "max_factor", "mean_factor", "sample_count", "mean_return",
        "median_return", "up_ratio", "win_count", "loss_count",
    )


# --------------------------------------------------------------------------
# direction summary
# --------------------------------------------------------------------------

def _vote(value: str, eps: float) -> str:
    return f"CASE WHEN {value} > {eps}D THEN 1 WHEN {value} < -{eps}D THEN -1 ELSE 0 END"


# Patterns, action hints and sides; "middle" rows differ by their risk side.  The reasons are free text.
SHAPES = {
    "higher_better": ("prefer_high_values", "none", "Returns rise with the factor and its top bucket holds up."),
    "lower_better": ("prefer_low_values", "none", "Returns fall with the factor and its bottom bucket holds up."),
    "middle_both": ("use_middle_range", "both_tails", "Both ends trail a best bucket between them."),
    "high_extreme_risk": ("cap_high_values", "high", "The top bucket trails the middle or comes last."),
    "low_extreme_risk": ("floor_low_values", "low", "The bottom bucket trails the middle or comes last."),
    "middle_plain": ("use_middle_range", "none", "An inner bucket leads, so neither direction alone helps."),
    "weak_or_unclear": ("ignore_for_now", "none", "Neither direction nor shape stands out."),
    "binary_true_better": ("prefer_true", "false_side", "Rows with the flag do better."),
    "binary_false_better": ("prefer_false", "true_side", "Rows without the flag do better."),
    "binary_no_clear_edge": ("neutral", "none", "The flag makes no difference."),
}
# Report order of the patterns.
PATTERN_ORDER = [
    "high_extreme_risk", "low_extreme_risk", "middle_range_best", "higher_better", "lower_better",
    "binary_true_better", "binary_false_better", "binary_no_clear_edge", "weak_or_unclear",
]


def classify(df: DataFrame) -> DataFrame:
    """Name the bucket shape of each summary row and what to do about it."""
    ret, up = RETURN_EPS, UP_EPS

    def weak(side: str, bucket: str) -> str:
        return (
            f"({side}_vs_middle_return < -{ret}D OR {side}_vs_middle_up_ratio < -{up}D OR worst_bucket = {bucket})"
        )

    top_weak, bottom_weak = weak("top", "bucket_count_actual"), weak("bottom", "1")
    spread = f"best_minus_worst_return > {ret}D"
    in_middle = "best_bucket > 1 AND best_bucket < bucket_count_actual"
    gap, up_gap = "top_minus_bottom_return", "top_minus_bottom_up_ratio"
    df = extend(df, {"_shape": f"""CASE
        WHEN distinct_count = 2 THEN CASE
            WHEN ({gap} > {ret}D AND NOT {up_gap} < -{up}D) OR ({up_gap} > {up}D AND NOT {gap} < -{ret}D) THEN 'binary_true_better'
            WHEN ({gap} < -{ret}D AND NOT {up_gap} > {up}D) OR ({up_gap} < -{up}D AND NOT {gap} > {ret}D) THEN 'binary_false_better'
            ELSE 'binary_no_clear_edge' END
        WHEN monotonic_votes >= 3 AND NOT {top_weak} THEN 'higher_better'
        WHEN monotonic_votes <= -3 AND NOT {bottom_weak} THEN 'lower_better'
        WHEN {spread} AND {in_middle} AND {top_weak} AND {bottom_weak} THEN 'middle_both'
        WHEN {spread} AND {top_weak} THEN 'high_extreme_risk'
        WHEN {spread} AND {bottom_weak} THEN 'low_extreme_risk'
        WHEN {spread} AND {in_middle} THEN 'middle_plain'
        ELSE 'weak_or_unclear' END"""})

    def pick(i: int) -> str:
        return "CASE _shape " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in SHAPES.items()) + " END"

    return extend(df, {
        "bucket_pattern": "CASE WHEN _shape LIKE 'middle%' THEN 'middle_range_best' ELSE _shape END",
        "action_hint": pick(0), "risk_side": pick(1), "pattern_reason": pick(2),
    }).drop("_shape")


SUMMARY_COLUMNS = [
    "schema_version", "factor", "bucket_pattern", "action_hint", "risk_side", "pattern_reason", "monotonic_bias",
    "monotonic_votes", "vote_spearman", "vote_pearson", "vote_tail_return", "vote_tail_up_ratio", "sample_count",
    "bucket_count_actual", "spearman_ic", "pearson_ic", "bottom_bucket", "top_bucket", "bottom_mean_return",
    "middle_mean_return", "top_mean_return", "top_minus_bottom_return", "top_vs_middle_return",
    "bottom_vs_middle_return", "bottom_up_ratio", "middle_up_ratio", "top_up_ratio", "top_minus_bottom_up_ratio",
    "top_vs_middle_up_ratio", "bottom_vs_middle_up_ratio", "best_bucket", "worst_bucket", "best_bucket_mean_return",
    "worst_bucket_mean_return", "best_minus_worst_return", "best_bucket_up_ratio", "worst_bucket_up_ratio",
    "best_minus_worst_up_ratio",
]


def summarize_direction(detail: DataFrame, ics: DataFrame, cuts: DataFrame) -> DataFrame:
    """Second-level aggregate over bucket rows: extremes, middle, spreads, votes, shape.

    The arrays hold one entry per bucket, so at most ``n_bins`` entries.
    """
    arr = detail.groupBy(*KEYS).agg(F.expr(
        "array_sort(collect_list(struct(CAST(bucket AS INT) AS bucket, mean_return AS ret, up_ratio AS up))) AS b"
    )).filter("size(b) >= 2")
    middle = "CASE WHEN size(b) >= 3 THEN slice(b, 2, size(b) - 2) ELSE b END"
    arr = extend(arr, {"m": middle, "lo": "b[0]", "hi": "element_at(b, -1)"})
    arr = extend(arr, {
        "middle_mean_return": "aggregate(m, 0.0D, (a, v) -> a + v.ret) / size(m)",
        "middle_up_ratio": "aggregate(m, 0.0D, (a, v) -> a + v.up) / size(m)",
        "best": "aggregate(b, b[0], (a, v) -> CASE WHEN v.ret > a.ret THEN v ELSE a END)",
        "worst": "aggregate(b, b[0], (a, v) -> CASE WHEN v.ret < a.ret THEN v ELSE a END)",
    })
    df = arr.selectExpr(
        *KEYS, "size(b) AS bucket_count_actual", "middle_mean_return", "middle_up_ratio",
        "lo.bucket AS bottom_bucket", "lo.ret AS bottom_mean_return", "lo.up AS bottom_up_ratio",
        "hi.bucket AS top_bucket", "hi.ret AS top_mean_return", "hi.up AS top_up_ratio",
        "best.bucket AS best_bucket", "best.ret AS best_bucket_mean_return", "best.up AS best_bucket_up_ratio",
        "worst.bucket AS worst_bucket", "worst.ret AS worst_bucket_mean_return", "worst.up AS worst_bucket_up_ratio",
    )
    df = extend(df, {
        "top_minus_bottom_return": "top_mean_return - bottom_mean_return",
        "top_vs_middle_return": "top_mean_return - middle_mean_return",
        "bottom_vs_middle_return": "bottom_mean_return - middle_mean_return",
        "top_minus_bottom_up_ratio": "top_up_ratio - bottom_up_ratio",
        "top_vs_middle_up_ratio": "top_up_ratio - middle_up_ratio",
        "bottom_vs_middle_up_ratio": "bottom_up_ratio - middle_up_ratio",
        "best_minus_worst_return": "best_bucket_mean_return - worst_bucket_mean_return",
        "best_minus_worst_up_ratio": "best_bucket_up_ratio - worst_bucket_up_ratio",
    })
    df = df.join(F.broadcast(ics.select(*KEYS, "spearman_ic", "pearson_ic")), KEYS, "left")
    df = df.join(F.broadcast(cuts.select(*KEYS, "sample_count", "distinct_count")), KEYS)
    df = extend(df, {
        "schema_version": f"'{SCHEMA_VERSION}'",
        "vote_spearman": _vote("spearman_ic", IC_EPS),
        "vote_pearson": _vote("pearson_ic", IC_EPS),
        "vote_tail_return": _vote("top_minus_bottom_return", RETURN_EPS),
        "vote_tail_up_ratio": _vote("top_minus_bottom_up_ratio", UP_EPS),
    })
    df = extend(df, {"monotonic_votes": "vote_spearman + vote_pearson + vote_tail_return + vote_tail_up_ratio"})
    df = extend(df, {"monotonic_bias": (
        "CASE WHEN monotonic_votes >= 3 THEN 'higher_better' WHEN monotonic_votes <= -3 THEN 'lower_better'"
        " ELSE 'mixed_or_weak' END")})
    return classify(df).select("target_col", *SUMMARY_COLUMNS)


def _report_order() -> list[Column]:
    """Pattern priority, then spread, votes and rank correlation."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PATTERN_ORDER]), F.col("bucket_pattern"))
    return [
        rank, F.desc_nulls_last("best_minus_worst_return"), F.desc(F.abs("monotonic_votes")),
        F.desc_nulls_last(F.abs("spearman_ic")), F.col("factor"), F.col("target_col"),
    ]


def order_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*_report_order())


def report_places(summary: DataFrame) -> DataFrame:
    """The summary with each row's ``place`` in the report; one row per pair of pool columns, so one task ranks them."""
    return summary.withColumn("place", F.row_number().over(Window.orderBy(*_report_order())))


#: Targets are told apart in so many cells when medians are looked for; any number gives the same medians.
CELLS = 64


def _check_targets(pool: DataFrame, targets: Sequence[str]) -> None:
    for t in targets:
        if t not in pool.columns:
            raise ValueError(f"the pool has no target {t}")
        if t.startswith(("fwd_close_T", "fwd_up_T")):
            raise ValueError(f"{t} is no return: targets are fwd_return_pct_T1 to fwd_return_pct_T20")


def scan_cuts(data: DataFrame, factors: Sequence[str], targets: Sequence[str], buckets: int, least: int) -> DataFrame:
    """Per (factor, target): sample size, correlations, and the ``edges`` or ``levels`` of its buckets.

    Pairs below ``least`` rows or with one value are dropped.  Correlations use every row.
    """
    grid = correlation_grid(data, [], factors, targets, cuts=buckets).withColumnRenamed("n", "sample_count")
    grid = materialize(grid.filter((F.col("sample_count") >= least) & (F.col("distinct_count") >= 2)), "grid")
    few = grid.filter(F.col("distinct_count") <= buckets).select(*KEYS)
    # At most one name per pool column, and at most ``buckets`` values per pair.
    names = [r[0] for r in few.select("factor").distinct().collect()]
    if not names:
        return grid.withColumn("levels", F.lit(None).cast("array<double>"))
    rows = factor_target_rows(data, sorted(names), targets).join(F.broadcast(few), KEYS)
    levels = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_set("x")).alias("levels"))
    out = grid.join(F.broadcast(levels), KEYS, "left")
    return out.withColumn("edges", F.when(F.col("levels").isNull(), F.col("edges")))


def _scanned(data: DataFrame, factors: Sequence[str], targets: Sequence[str], cuts: DataFrame, buckets: int, marks: dict[str, list[float]]) -> DataFrame:
    """(factor, target_col, x, y, cell, bucket): all rows of all pairs, without a shuffle."""
    def cell(t: str) -> str:
        edges = ", ".join(f"{m!r}D" for m in sorted(set(marks[t] or [])))
        return f"size(filter(array({edges}), e -> e < `{t}`))" if edges else "0"

    ys = ", ".join(f"struct('{t}' AS target_col, `{t}` AS y, {cell(t)} AS cell)" for t in targets)
    xs = ", ".join(f"struct('{f}' AS factor, `{f}` AS x)" for f in factors)
    tall = data.selectExpr(f"filter(array({ys}), s -> s.y IS NOT NULL) AS _ys", *[f"`{f}`" for f in factors])
    tall = tall.selectExpr("_ys", f"inline(array({xs}))").where("x IS NOT NULL").selectExpr("factor", "x", "inline(_ys)")
    bounds = cuts.selectExpr(*KEYS, "levels IS NOT NULL AS few", *[f"get(coalesce(levels, edges), {i}) AS c{i}" for i in range(buckets + 1)])
    passed = " + ".join(f"IF(c{i} < x OR (few AND c{i} = x), 1, 0)" for i in range(buckets + 1))
    return tall.join(F.broadcast(bounds), KEYS).selectExpr("factor", "target_col", "x", "y", "cell", f"greatest(1, {passed}) AS bucket")


def scan_detail(data: DataFrame, factors: Sequence[str], targets: Sequence[str], cuts: DataFrame, buckets: int) -> DataFrame:
    """:func:`bucket_detail` of all pairs.

    One aggregate counts rows per bucket and cell of the target; cells are cut at approximate quantiles of it.  A
    bucket's median lies in one or two cells, whose rows alone are ranked.
    """
    points = ", ".join(f"{k / CELLS}D" for k in range(1, CELLS))
    marks = data.agg(*[F.expr(f"percentile_approx(`{t}`, array({points}), 1000) AS `{t}`") for t in targets]).first().asDict()
    rows = _scanned(data, factors, targets, cuts, buckets, marks)
    keys = [*KEYS, "bucket"]
    cells = materialize(rows.groupBy(*keys, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.expr("count_if(y > 0) AS wins")), "cells")
    stats = cells.groupBy(*keys).agg(
        F.sum("n").alias("sample_count"), F.min("lo").alias("min_factor"), F.max("hi").alias("max_factor"),
        (F.sum("sx") / F.sum("n")).alias("mean_factor"), (F.sum("sy") / F.sum("n")).alias("mean_return"),
        (F.sum("wins") / F.sum("n")).alias("up_ratio"), F.sum("wins").alias("win_count"), (F.sum("n") - F.sum("wins")).alias("loss_count"))
    of = Window.partitionBy(*keys)
    placed = cells.select(*keys, "cell", "n", F.coalesce(F.sum("n").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(of).alias("size"))
    # At most two cells per bucket: bounded by columns times buckets.
    middle = placed.where("ahead <= size div 2 AND (size - 1) div 2 < ahead + n").select(*keys, "cell", "ahead", "size")
    spots = value_positions(rows.join(F.broadcast(middle), [*keys, "cell"]).select(*keys, "ahead", "size", "y"), [*keys, "ahead", "size"], "y")
    at = "max(CASE WHEN ahead + _before <= {0} AND {0} < ahead + _before + _n THEN y END)"
    low, high = at.format("(size - 1) div 2"), at.format("size div 2")
    medians_of = spots.groupBy(*keys).agg(F.expr(f"{low} + ({high} - {low}) * 0.5D AS median_return"))
    return stats.join(F.broadcast(medians_of), keys).select(*DETAIL_COLUMNS)


def analyze_direction(
    pool: DataFrame,
    targets: Sequence[str],
    factors: Sequence[str] | None = None,
    buckets: int = 10,
    least: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """(summary, bucket detail) for every factor, by default all that are detected, against every target."""
    _check_targets(pool, targets)
    names = factor_columns(pool, targets, factors)
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    if not names:
        empty = pool.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c in KEYS else 'bigint' if c.endswith('count') else 'int' if c == 'bucket' else 'double'}" for c in DETAIL_COLUMNS))
        cuts = empty.selectExpr(*KEYS, "sample_count", "0L AS distinct_count", "0.0D AS spearman_ic", "0.0D AS pearson_ic")
        return summarize_direction(empty, cuts, cuts), empty
    data = materialize(pool.selectExpr(*[f"{number_sql(c, kinds[c])} AS `{c}`" for c in (*names, *targets)]), "analysis")
    cuts = materialize(scan_cuts(data, names, targets, buckets, least), "cuts")
    detail = materialize(scan_detail(data, names, targets, cuts, buckets), "bucket-detail")
    return summarize_direction(detail, cuts, cuts), detail


# --------------------------------------------------------------------------
# extreme buckets
# --------------------------------------------------------------------------

def refine_extremes(
    pool: DataFrame,
    factors: Sequence[str] | str,
    targets: Sequence[str],
    buckets: int = 10,
    sub_buckets: int = 5,
    least: int = 10000,
    sides: Sequence[str] = ("lowest", "highest"),
) -> tuple[DataFrame, DataFrame]:
    """(summary, detail): the outermost rank buckets of each factor, split again.

    Ties are placed in (date, symbol) order.  Each factor is sorted once for all targets; a row's place
    inside its bucket is its place in the factor less that of the bucket's first row.
    """
    names = [factors] if isinstance(factors, str) else list(factors)
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    xs = ", ".join(f"struct('{f}' AS factor, {number_sql(f, kinds[f])} AS x)" for f in names)
    tall = pool.selectExpr("date", "symbol", *[f"{number_sql(t, kinds[t])} AS _y{i}" for i, t in enumerate(targets)], f"inline(array({xs}))")
    tall = tall.where("x IS NOT NULL").withColumn("place", F.struct("x", "date", "symbol"))
    ranked = ranks_in_place(tall, ["factor"], "place", "place", [f"IF(_y{i} IS NULL, 0, 1)" for i in range(len(targets))], {
        "target_col": [f"'{t}'" for t in targets], "y": [f"_y{i}" for i in range(len(targets))]})
    rows = ranked.selectExpr("factor", "place.x AS x", "inline(ranks)").where("w > 0").drop("w", "ties")
    rows = rows.withColumn("source_bucket", rank_bucket(F.col("before") + 1, F.col("total"), buckets))
    last = rank_bucket(F.col("total"), F.col("total"), buckets)
    rows = rows.withColumn("source_bucket_type", F.when(F.col("source_bucket") == 1, "lowest").when(F.col("source_bucket") == last, "highest"))
    ends = materialize(rows.filter(F.col("source_bucket_type").isin(*sides)), "extremes")
    source_keys = [*KEYS, "source_bucket_type", "source_bucket"]
    # One row per factor, target and side.
    starts = ends.groupBy(*source_keys).agg(F.min("before").alias("_start"), F.count(F.lit(1)).alias("_size"))
    parts = ends.join(F.broadcast(starts), source_keys).withColumn(
        "sub_bucket", rank_bucket(F.col("before") - F.col("_start") + 1, F.col("_size"), sub_buckets)).drop("_start", "_size")

    def describe(df: DataFrame, keys: list[str], interval: str, metric: str) -> DataFrame:
        stats = df.groupBy(*keys).agg(
            F.min("x").alias(f"{interval}min_factor"), F.max("x").alias(f"{interval}max_factor"),
            F.avg("x").alias(f"{interval}mean_factor"), *return_stats("y", metric),
        )
        mid = medians(df, keys, {f"{interval}median_factor": "x", f"{metric}median_return": "y"})
        return stats.join(F.broadcast(mid), keys)

    summary = describe(ends, source_keys, "source_", "source_")
    detail = describe(parts, [*source_keys, "sub_bucket"], "sub_", "")
    detail = detail.join(F.broadcast(summary.select(*source_keys, "source_mean_return")), source_keys)
    detail = extend(detail, {
        "mean_return_vs_source": "mean_return - source_mean_return",
        "sample_ok": f"sample_count >= {int(least)}",
    }).drop("source_mean_return")
    sizes = {"bucket_count": str(int(buckets)), "sub_bucket_count": str(int(sub_buckets))}
    return extend(summary, sizes), extend(detail, sizes)


#: What a sample row shows besides its value, where the pool has it.
SAMPLE_COLUMNS = ["file", "selection_strategy", "open", "high", "low", "close", "volume", "amount"]


def extreme_samples(pool: DataFrame, detail: DataFrame) -> DataFrame:
    """For each bucket boundary of ``detail`` the first pool row at that value, or the nearest one.

    "First" is (date, symbol) order; a row is at a boundary if it differs by at most its 1e-9th part or 1e-10.  All factors
    and targets of ``detail`` go together.  The boundaries of a pair cut the line into gaps.  One aggregate finds
    the least and greatest value in each gap; the greatest of the last gap with rows before a boundary and the
    least of the first one after it are its neighbours.  A second pass takes the rows at the values so
    chosen.  Boundaries are two per bucket, hence bounded by columns times buckets, and broadcast; rows are not shuffled.
    """
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    names, targets = ([r[0] for r in detail.select(c).distinct().orderBy(c).collect()] for c in KEYS)
    if not names:
        raise ValueError("there are no buckets to look up")
    bounds = detail.selectExpr(*KEYS, "bucket", "inline(array(struct('min' AS side, CAST(min_factor AS DOUBLE) AS bound), struct('max' AS side, CAST(max_factor AS DOUBLE) AS bound)))").where("bound IS NOT NULL")
    values = materialize(bounds.groupBy(*KEYS).agg(F.array_sort(F.collect_set("bound")).alias("values")), "bounds")
    rows = factor_target_rows(pool, names, targets, ["date", "symbol"]).join(F.broadcast(values), KEYS)
    # The gap of a value is the number of boundaries up to it.
    rows = rows.withColumn("gap", F.expr("aggregate(values, 0, (a, v) -> a + IF(v <= x, 1, 0))")).drop("values")
    gaps = rows.groupBy(*KEYS, "gap").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    marks = values.selectExpr(*KEYS, "posexplode(values) AS (i, bound)").selectExpr(*KEYS, "i + 1 AS gap", "bound")
    every = values.selectExpr(*KEYS, "explode(sequence(0, size(values))) AS gap").join(gaps, [*KEYS, "gap"], "left")
    of = Window.partitionBy(*KEYS).orderBy("gap")
    # At a boundary: the nearest values before it and from it on, with their gaps.
    beside = every.withColumns({
        "below": F.last(F.when(F.col("hi").isNotNull(), F.struct("hi", "gap")), ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, -1)),
        "above": F.first(F.when(F.col("lo").isNotNull(), F.struct("lo", "gap")), ignorenulls=True).over(of.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).select(*KEYS, "gap", "below", "above")
    near = marks.join(beside, [*KEYS, "gap"]).selectExpr(
        *KEYS, "bound", "gap", "greatest(abs(bound) * 1e-9D, 1e-10D) AS margin", "below", "above", "bound - below.hi AS down", "above.lo - bound AS up")
    near = near.withColumn("exact", F.expr("coalesce(down <= margin, false) OR coalesce(up <= margin, false)"))
    # Rows to take: around an exact boundary on both sides, else the nearer neighbour, both if equally near.
    wanted = near.selectExpr(*KEYS, "bound", "exact", """inline(filter(array(
        struct(below.gap AS gap, IF(exact, bound - margin, below.hi) AS from, below.hi AS to, IF(exact, 0.0D, down) AS away, IF(exact, down <= margin, up IS NULL OR down <= up) AS ok),
        struct(above.gap AS gap, above.lo AS from, IF(exact, bound + margin, above.lo) AS to, IF(exact, 0.0D, up) AS away, IF(exact, up <= margin, down IS NULL OR up <= down) AS ok)), s -> s.ok AND s.gap IS NOT NULL))""").drop("ok")
    wanted = materialize(wanted, "wanted")
    hits = rows.join(F.broadcast(wanted), [*KEYS, "gap"]).where("x BETWEEN from AND to")
    first = hits.groupBy(*KEYS, "bound", "exact").agg(F.min_by(F.struct("x", "y", "date", "symbol"), F.struct("date", "symbol")).alias("s"))
    found = bounds.join(F.broadcast(first), [*KEYS, "bound"]).selectExpr(
        "target_col", "factor", "bucket", "side AS extreme_side", "bound AS bucket_extreme_value", "s.x AS sample_factor_value",
        "IF(exact, 'exact', 'nearest') AS match_type", "s.symbol AS symbol", "s.date AS date", "s.y AS target_value")
    shown = [c for c in (*SAMPLE_COLUMNS, *(f"fwd_return_pct_T{h}" for h in range(1, 21))) if c in kinds]
    return F.broadcast(found).join(pool.select("date", "symbol", *shown), ["date", "symbol"])
