"""Exact ranks, quantiles and correlations of groups of any size.

A group (one factor, one trading day, one bucket) may hold a large share of the
whole table, so nothing here gathers a group into one task.  Rows are range-
partitioned by (group, value): a big group spreads over many slices and a
slice may hold many small groups.  Positions inside a slice plus the counts of
the slices before it give exact positions.

The sliced rows are written to scratch first.  Range bounds come from sampling,
so the slice numbers must be stored, not recomputed, to stay consistent when an
executor is lost.

Equal values are first counted (``value_counts``), so ties never pile up in one
slice either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.scratch import materialize


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values of each group with their number of rows in ``_n``."""
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(counted.alias("_n"))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """Append ``_before``, ``_dense``, ``_total`` and ``_distinct`` to every row.

    ``_before`` is the weight of the rows ahead in the group (rows themselves
    when no weight is given), ``_dense`` the 1-based row number, ``_total`` the
    weight of the whole group and ``_distinct`` its number of rows.  ``order``
    must be unique within a group.  NULL is a group like any other.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    columns = df.columns
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(
        df.repartitionByRange(slices, *[F.col(c) for c in (*keys, *order)]).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    # At most one row per (group, slice): a group has no more rows here than there are slices.
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_r"))
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_slice").alias("_of"),
            F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0"),
            F.coalesce(F.sum("_r").over(ahead), F.lit(0)).alias("_r0"),
            F.sum("_w").over(group).alias("_total"),
            F.sum("_r").over(group).alias("_distinct"),
        )
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_slice") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return (
        sliced.withColumns({"_w": F.sum(w).over(inside), "_r": F.count(F.lit(1)).over(inside)})
        .join(offsets, same)
        .select(*columns, (F.col("_w0") + F.col("_w") - w).alias("_before"), (F.col("_r0") + F.col("_r")).alias("_dense"), "_total", "_distinct")
    )


def ranks_in_place(df: DataFrame, keys: Sequence[str], value: str, tie: str, weights: Sequence[str], carry: dict[str, Sequence[str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rank the rows of each group under several weights at once, by one sort and without a join on the value.

    Returns ``keys``, ``value``, ``keep`` and ``ranks``: one struct per weight with its
    value ``w`` in the row, the weights summed over smaller (``before``), equal (``ties``)
    and all values (``total``) of the group, and the expressions ``carry`` names, one per weight.
    Weights and carried values are SQL text; ``value`` must not be NULL.

    Rows are range-sorted by (group, value, ``tie``), so equal values may spread over
    slices; ``tie`` is unique among them.  Inside a slice windows do the work.  Ties over
    slice edges are settled by each slice's first and last value: one small row per (group, slice).
    """
    carry = carry or {}
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.selectExpr(*keys, value, tie, *[c for c in keep if c != tie], *[f"{w} AS _w{i}" for i, w in enumerate(weights)],
                         *[f"{e} AS _{name}{i}" for name, each in carry.items() for i, e in enumerate(each)])
    rows = rows.repartitionByRange(slices, *[F.col(c) for c in (*keys, value, tie)]).withColumn("_slice", F.spark_partition_id())
    upto = Window.partitionBy(*keys, "_slice").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*keys, "_slice", value)
    numbers = range(len(weights))
    summed = rows.withColumns({f"_u{i}": F.sum(f"_w{i}").over(upto) for i in numbers}).withColumns({f"_e{i}": F.sum(f"_w{i}").over(peers) for i in numbers})
    local = ", ".join(
        f"struct(_w{i} AS w, _u{i} - _e{i} AS b, _e{i} AS e" + "".join(f", _{name}{i} AS {name}" for name in carry) + ")" for i in numbers)
    stored = materialize(summed.selectExpr(*keys, value, *[c for c in keep if c != value], "_slice", f"array({local}) AS _local"), "ranked")

    ends = stored.groupBy(*keys, "_slice").agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.min_by("_local", value).alias("first"), F.max_by("_local", value).alias("last"))
    each = ends.selectExpr(*keys, "_slice", "lo", "hi", "posexplode(arrays_zip(first, last)) AS (i, at)").selectExpr(
        *keys, "_slice", "i", "lo", "hi", "at.first.e AS lo_n", "at.last.b AS hi_b", "at.last.e AS hi_n", "at.last.b + at.last.e AS n")
    of = Window.partitionBy(*keys, "i")
    each = each.withColumns({"ahead": F.coalesce(F.sum("n").over(of.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(of)})
    # A value on a slice edge may go on in the slices beside it: the first place and all rows of it count.
    edges = each.selectExpr(*keys, "_slice", "i", "ahead", "total", "inline(array(struct(0 AS side, lo AS v, ahead AS b, lo_n AS n), struct(1 AS side, hi AS v, ahead + hi_b AS b, IF(hi = lo, 0, hi_n) AS n)))")
    same = Window.partitionBy(*keys, "i", "v")
    edges = edges.withColumns({"b": F.min("b").over(same), "n": F.sum("n").over(same)})
    settled = edges.groupBy(*keys, "_slice", "i").agg(
        F.max("ahead").alias("ahead"), F.max("total").alias("total"), *[F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{name}_{c}")
                                                                      for side, name in enumerate(("lo", "hi")) for c in ("v", "b", "n")])
    offsets = settled.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_slice").alias("_of")).agg(
        F.max("lo_v").alias("_lo"), F.max("hi_v").alias("_hi"), F.array_sort(F.collect_list(F.struct("i", "ahead", "total", "lo_b", "lo_n", "hi_b", "hi_n"))).alias("_edge"))
    matched = F.col("_slice") == F.col("_of")
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    more = "".join(f", '{name}', s.{name}" for name in carry)
    ranks = f"""transform(_local, (s, i) -> named_struct('w', s.w,
        'before', CASE WHEN {value} = _lo THEN _edge[i].lo_b WHEN {value} = _hi THEN _edge[i].hi_b ELSE _edge[i].ahead + s.b END,
        'ties', CASE WHEN {value} = _lo THEN _edge[i].lo_n WHEN {value} = _hi THEN _edge[i].hi_n ELSE s.e END,
        'total', _edge[i].total{more})) AS ranks"""
    return stored.join(offsets, matched).selectExpr(*keys, value, *[c for c in keep if c != value], ranks)


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values of each group with ``_n``, ``_before``, ``_dense``, ``_total``, ``_distinct``."""
    return positions(value_counts(df, keys, value, weight), keys, [value], "_n")


def quantile(value: str, k: int, q: int) -> Column:
    """Aggregate over :func:`value_positions` rows: the k/q quantile, linear between ranks.

    The rank (n-1)k/q is split with integer arithmetic, so a quantile that falls
    exactly on a row is that row's value.
    """
    low = F.expr(f"((_total - 1) * {k}) div {q}")
    rest = F.expr(f"((_total - 1) * {k}) % {q}")
    high = F.when(rest > 0, low + 1).otherwise(low)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value)))

    return at(low) + (at(high) - at(low)) * (F.max(rest) / F.lit(float(q)))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """Exact quantiles per group: ``wanted`` maps an output name to k/q."""
    spots = value_positions(df, keys, value)
    return spots.groupBy(*keys).agg(*[quantile(value, k, q).alias(name) for name, (k, q) in wanted.items()])


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Median of several columns per group; ``values`` maps output name to column."""
    names = list(values)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_which"), F.col(values[n]).cast("double").alias("_x")) for i, n in enumerate(names)
    ])).alias("_s")).select(*keys, "_s.*")
    mid = quantiles(long, [*keys, "_which"], "_x", {"_median": (1, 2)})
    return mid.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_which") == i, F.col("_median"))).alias(n) for i, n in enumerate(names)
    ])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank of each distinct value, ties averaged, with the group size in ``_total``."""
    return value_positions(df, keys, value).select(
        *keys, value, "_total", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name)
    )


def rank_bucket(position: Column, total: Column, buckets: Column | int) -> Column:
    """Bucket 1..q of a 1-based position: equal-count cuts of the rank scale."""
    q = F.least(F.lit(buckets) if isinstance(buckets, int) else buckets, total)
    cut = F.ceil(((position - 1) * q) / F.nullif(total - 1, F.lit(0)))
    return F.coalesce(F.greatest(cut, F.lit(1)), F.lit(1)).cast("int")


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """``pearson_ic`` and ``spearman_ic`` per group; NULL below ``least`` rows.

    Rows with the same (x, y) collapse first.  Ranks are centred on their known
    mean (n+1)/2, so the sums keep full precision for very large groups.
    """
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x, y)
        .agg(F.count(F.lit(1)).alias("_pairs"))
    )
    pairs = materialize(pairs, "pairs")
    rx = value_positions(pairs, keys, x, F.col("_pairs")).select(
        *keys, x, F.col("_total").alias("_size"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("_rx"))
    ry = value_positions(pairs, keys, y, F.col("_pairs")).select(
        *keys, y, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("_ry"))
    ranked = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    means = pairs.groupBy(*keys).agg(
        (F.sum(F.col(x) * F.col("_pairs")) / F.sum("_pairs")).alias("_mx"),
        (F.sum(F.col(y) * F.col("_pairs")) / F.sum("_pairs")).alias("_my"),
    )
    w = F.col("_pairs")
    a, b = F.col("_rx") - (F.col("_size") + 1) / 2.0, F.col("_ry") - (F.col("_size") + 1) / 2.0
    u, v = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    # Sums of squares of a constant column are zero up to rounding; ranks decide constancy exactly.
    moving = (F.sum(a * a * w) > 0) & (F.sum(b * b * w) > 0) & (F.sum(w) >= least)
    return (
        ranked.join(means, list(keys))
        .groupBy(*keys)
        .agg(
            F.sum(w).alias("_rows"),
            F.when(moving, F.try_divide(F.sum(a * b * w), F.sqrt(F.sum(a * a * w)) * F.sqrt(F.sum(b * b * w)))).alias("spearman_ic"),
            F.when(moving, F.try_divide(F.sum(u * v * w), F.sqrt(F.sum(u * u * w)) * F.sqrt(F.sum(v * v * w)))).alias("pearson_ic"),
        )
    )
