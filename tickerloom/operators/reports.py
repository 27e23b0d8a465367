"""Pool reports: return curve, multi-factor combinations, the single-factor view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalars import code_in_parts, extend, parse_boolean
from tickerloom.operators.factors import bucket_of, cuts_of, number_sql, rank_buckets
from tickerloom.operators.pool import entry_gap, unpivot_targets
from tickerloom.operators.ranking import medians, quantiles, value_positions
from tickerloom.scratch import materialize

RETURNS = {"t2": "t2_return_pct", "t3": "t3_return_pct"}


def forward_curve(pool: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Return distribution per horizon."""
    long = unpivot_targets(pool, targets)
    y = F.col("target_value")
    stats = long.groupBy("target_col").agg(
        F.count(y).alias("sample_count"), F.avg(y).alias("mean_return"),
        F.avg((y > 0).cast("double")).alias("up_ratio"),
    )
    cuts = quantiles(long, ["target_col"], "target_value", {"p25_return": (1, 4), "median_return": (1, 2), "p75_return": (3, 4)})
    # One row per horizon on both sides.
    return stats.join(F.broadcast(cuts), "target_col").select(
        F.regexp_extract("target_col", r"_T(\d+)$", 1).cast("int").alias("horizon"),
        "target_col", "sample_count", "mean_return", "median_return", "p25_return", "p75_return", "up_ratio",
    )


# --------------------------------------------------------------------------
# multi-factor combination
# --------------------------------------------------------------------------

def combination_rows(
    pool: DataFrame, chosen: dict[str, Sequence[int]], buckets: dict[str, int] | int = 10
) -> DataFrame:
    """Pool rows whose bucket is among the chosen ones for every factor.

    Buckets are cut on the whole pool, all factors in one pass.  A factor of two values has
    one bucket per value; others have quantile cuts, no more than distinct values.
    ``buckets`` may come from an earlier bucket table (:func:`bucket_counts`).
    """
    for factor, picked in chosen.items():
        if not picked:
            raise ValueError(f"select at least one bucket for {factor}")
    pool = entry_gap(pool) if "t1_open_gap_pct" in chosen else pool
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    count = (lambda f: buckets) if isinstance(buckets, int) else (lambda f: buckets.get(f, 10))
    xs = ", ".join(f"struct('{f}' AS factor, {number_sql(f, kinds[f])} AS x)" for f in chosen)
    spots = materialize(value_positions(pool.select(F.expr(f"inline(array({xs}))")).filter("x IS NOT NULL"), ["factor"], "x"), "combination")
    # One row per factor.
    distinct = {r["factor"]: r["d"] for r in spots.groupBy("factor").agg(F.max("_distinct").alias("d")).collect()}
    flat = [f for f in chosen if distinct.get(f, 0) < 2]
    if flat:
        raise ValueError(f"factors with fewer than two values to cut: {flat}")
    each = [cuts_of(spots.filter(F.col("factor") == f), ["factor"], min(max(2, count(f)), distinct[f]), few_values=2) for f in chosen]
    cuts = {r["factor"]: r for r in reduce(DataFrame.unionByName, each).collect()}
    out = pool
    for f, picked in chosen.items():
        edges, levels = cuts[f]["edges"], cuts[f]["levels"]
        value = f"_x_{f}"
        out = out.withColumn(value, F.expr(number_sql(f, kinds[f])))
        # The cut points land in the plan as two short literal arrays.
        out = out.withColumns({
            "edges": F.lit(None).cast("array<double>") if edges is None else F.array(*[F.lit(e) for e in edges]),
            "levels": F.lit(None).cast("array<double>") if levels is None else F.array(*[F.lit(e) for e in levels]),
        })
        out = out.withColumn(f"{f}__bucket", F.when(F.col(value).isNotNull(), bucket_of(value))).drop("edges", "levels", value)
        out = out.filter(F.col(f"{f}__bucket").isin([int(b) for b in picked]))
    return out


def bucket_counts(detail: DataFrame) -> dict[str, int]:
    """Number of buckets per factor of an earlier bucket table, at least two: one row per factor."""
    return {r["factor"]: max(2, int(r["q"])) for r in detail.groupBy("factor").agg(F.max("bucket").alias("q")).filter("q IS NOT NULL").collect()}


def _performance(df: DataFrame, targets: Sequence[str], prefix: str) -> DataFrame:
    long = unpivot_targets(df, targets)
    y = F.col("target_value")
    stats = long.groupBy("target_col").agg(
        F.count(y).alias(f"{prefix}_sample_count"), F.avg(y).alias(f"{prefix}_mean_return"),
        F.avg((y > 0).cast("double")).alias(f"{prefix}_up_ratio"),
    )
    mid = quantiles(long, ["target_col"], "target_value", {f"{prefix}_median_return": (1, 2)})
    return stats.join(F.broadcast(mid), "target_col")


def combination_summary(
    pool: DataFrame, targets: Sequence[str], chosen: dict[str, Sequence[int]], buckets: dict[str, int] | int = 10
) -> DataFrame:
    """The combination against the whole pool, one row per target."""
    base = _performance(pool, targets, "benchmark")
    combo = _performance(combination_rows(pool, chosen, buckets), targets, "combo")
    df = base.join(F.broadcast(combo), "target_col", "left")
    df = extend(df, {"combo_sample_count": "coalesce(combo_sample_count, 0)"})
    return extend(df, {
        "benchmark": "'Strategy Pool Baseline'",
        "coverage_ratio": "try_divide(combo_sample_count, benchmark_sample_count)",
        "excess_mean_return": "combo_mean_return - benchmark_mean_return",
        "excess_up_ratio": "combo_up_ratio - benchmark_up_ratio",
    })


# --------------------------------------------------------------------------
# single-factor view
# --------------------------------------------------------------------------

def match_market(pool: DataFrame, market: DataFrame) -> DataFrame:
    """Pool rows with the market's T+1-open returns of the same symbol and date."""
    side = market.withColumn("symbol", code_in_parts("symbol"))
    left = pool.withColumn("symbol", code_in_parts("symbol")).drop("t1_open", "t2_close", "t3_close", *RETURNS.values())
    return left.join(side, ["symbol", "date"])


def factor_groups(df: DataFrame, kinds: dict[str, str], buckets: int = 10) -> DataFrame:
    """Bucket label per factor (``Q1``.. or True/False) and the combined group label."""
    out = df
    labels = [(f, f"{f}__bucket") for f in kinds]
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [f for f, kind in kinds.items() if kind != "boolean"]
    for factor, label in labels:
        if factor not in numeric:
            flag = parse_boolean(factor)
            out = out.withColumn(label, F.when(flag, "True").when(~flag, "False"))
    if numeric:
        # All factors are ranked in one pass and come back by one join.
        xs = ", ".join(f"struct('{f}' AS factor, {number_sql(f, types[f])} AS x)" for f in numeric)
        rows = df.select("date", "symbol", F.expr(f"inline(array({xs}))")).filter("x IS NOT NULL")
        placed = rank_buckets(rows, ["factor"], buckets, ["date", "symbol"], "bucket", by_distinct=True)
        wide = placed.groupBy("date", "symbol").agg(*[F.max(F.when(F.col("factor") == f, F.concat(F.lit("Q"), F.col("bucket")))).alias(f"{f}__bucket") for f in numeric])
        out = out.join(wide, ["date", "symbol"], "left")
    group = F.concat_ws(" | ", *[F.concat(F.lit(f"{f}="), F.col(c)) for f, c in labels])
    return out.withColumn("bucket_group", F.when(group != "", group))


def return_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, median and win rate of both returns per group.

    The win rate counts rows without a return as losses.
    """
    stats = df.groupBy(*keys).agg(*[e for p, r in RETURNS.items() for e in (
        F.expr(f"count({r}) AS {p}_sample_count"),
        F.expr(f"avg({r}) AS {p}_mean_return_pct"),
        F.expr(f"avg(CASE WHEN {r} > 0 THEN 1.0D ELSE 0.0D END) * 100.0D AS {p}_win_rate_pct"),
    )])
    mid = medians(df, keys, {f"{p}_median_return_pct": r for p, r in RETURNS.items()})
    return stats.join(mid, list(keys), "left")


def has_return(df: DataFrame) -> DataFrame:
    return df.filter("t2_return_pct IS NOT NULL OR t3_return_pct IS NOT NULL")


def group_metrics(df: DataFrame) -> DataFrame:
    """Metrics per combined bucket group, best T3 mean first."""
    out = return_metrics(df.filter("bucket_group IS NOT NULL"), ["bucket_group"])
    return out.orderBy(F.desc_nulls_last("t3_mean_return_pct"), F.desc_nulls_last("t2_mean_return_pct"), "bucket_group")


def bucket_ranges(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Value range, sizes and metrics of every bucket of every factor."""
    parts = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for factor, kind in kinds.items():
        x = number_sql(factor, types[factor]) if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        parts.append(f"struct('{factor}' AS factor, '{kind}' AS factor_type, `{factor}__bucket` AS bucket, {x} AS x)")
    long = df.select("date", *RETURNS.values(), F.expr(f"inline(array({', '.join(parts)}))")).filter("bucket IS NOT NULL")
    keys = ["factor", "factor_type", "bucket"]
    spec = long.groupBy(*keys).agg(
        F.min("x").alias("factor_min"), F.max("x").alias("factor_max"),
        F.count(F.lit(1)).alias("sample_count"), F.countDistinct("date").alias("date_count"),
    )
    mid = medians(long, keys, {"factor_median": "x"})
    spec = spec.join(F.broadcast(mid), keys, "left").join(F.broadcast(return_metrics(long, keys)), keys)
    shown = F.format_string("%s [%.6g, %.6g]", F.col("bucket"), F.col("factor_min"), F.col("factor_max"))
    return spec.withColumn("bucket_label", F.when(F.col("factor_type") == "numeric", shown).otherwise(F.col("bucket")))


def pick_buckets(df: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """Rows in a chosen bucket for every factor that have at least one return."""
    for factor, picked in chosen.items():
        df = df.filter(F.col(f"{factor}__bucket").isin(list(picked)))
    return has_return(df)


def baseline_rows(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pool or market rows on the dates that have a selected row."""
    dates = selected.select("date").distinct()
    # One row per calendar day: bounded.
    return has_return(candidates.join(F.broadcast(dates), "date", "left_semi"))


def daily_comparison(selected: DataFrame, baseline: DataFrame) -> DataFrame:
    """Selected against baseline per date, with excess mean return and win rate."""
    a, b = return_metrics(selected, ["date"]), return_metrics(baseline, ["date"])
    left = a.select("date", *[F.col(c).alias(f"{c}_bucket") for c in a.columns if c != "date"])
    right = b.select("date", *[F.col(c).alias(f"{c}_baseline") for c in b.columns if c != "date"])
    return extend(left.join(right, "date"), {
        f"{p}_excess_{m}_pct": f"{p}_{m}_pct_bucket - {p}_{m}_pct_baseline"
        for p in RETURNS for m in ("mean_return", "win_rate")
    })


def overall_delta(selected: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per side of the comparison and their difference."""
    both = has_return(selected).select(F.lit("selected").alias("side"), *RETURNS.values()).unionByName(
        has_return(baseline).select(F.lit("baseline").alias("side"), *RETURNS.values())
    )
    stats = materialize(return_metrics(both, ["side"]), "overall")
    names = [c for c in stats.columns if c != "side"]
    return stats.agg(*[
        e for c in names for e in (
            F.expr(f"max(CASE WHEN side = 'selected' THEN {c} END) AS {c}"),
            F.expr(f"max(CASE WHEN side = 'selected' THEN {c} END) - max(CASE WHEN side = 'baseline' THEN {c} END) AS {c}_delta"),
        )
    ])


def selected_detail(selected: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Compact listing of the selected rows in (date, symbol) order."""
    return selected.select(
        "date", "symbol", *factors, *[f"{f}__bucket" for f in factors], "bucket_group", "t1_open", "t2_close",
        "t3_close", *RETURNS.values(),
    ).orderBy("date", "symbol")
