"""Rank and value correlations, and exact quantiles, of every factor with every target at once.

Each target is sorted once for all factors, which gives its ranks, and each factor once for all targets.
The sorted rows of a factor are summed up in chunks, one per Arrow batch and group: counts, means and
co-moments of ranks and values, per target, from one numpy
pass.  A rank inside a chunk lacks only the number of rows ahead of the chunk, which is
added to the chunk's mean afterwards; the first and last run of equal values in a chunk, which may go on in
the neighbouring ones, are kept apart and get their place from all of their parts.  So a pair's
figures come from a few small rows per chunk, a value that most rows share is never held in memory, and neither
rows nor ranks of a factor are shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.ranking import ranks_in_place
from tickerloom.scratch import materialize

#: Parts of a chunk: its first run, the runs between, its last run, and the values of all its rows.
FIRST, INNER, LAST, VALUES = range(4)
_PARTS = "slice int, seq int, part int, v double, n array<long>, levels array<long>, am array<double>, a2 array<double>, bm array<double>, b2 array<double>, ab array<double>, xs binary, marks binary"


def _moments(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Per column: count, mean and squared deviations of both, and their co-deviation, where ``w``."""
    n = w.sum(axis=0)
    some = np.maximum(n, 1)
    a, b = np.where(w, a, 0.0), np.where(w, b, 0.0)
    am, bm = a.sum(axis=0) / some, b.sum(axis=0) / some
    da, db = np.where(w, a - am, 0.0), np.where(w, b - bm, 0.0)
    return [n, am, (da * da).sum(axis=0), bm, (db * db).sum(axis=0), (da * db).sum(axis=0)]


def chunk_parts(x: np.ndarray, y: np.ndarray, ry: np.ndarray) -> list[tuple]:
    """(part, value, counts, distinct values, moments) of sorted ``x`` with targets ``y`` and their ranks, one column per target."""
    w = ~np.isnan(y)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    ends = np.append(starts[1:], len(x))
    zero = np.zeros((len(x), 1))
    out = []
    for part, low, high in ((FIRST, 0, ends[0]), (INNER, ends[0], starts[-1]), (LAST, starts[-1] if len(starts) > 1 else len(x), len(x))):
        if low >= high:
            continue
        rank, levels = zero[low:high], None
        if part == INNER:
            inside = starts[1:-1] - low
            count = np.add.reduceat(w[low:high].astype(np.int64), inside, axis=0)
            rank = np.repeat(np.cumsum(count, axis=0) - count + (count + 1) / 2.0, np.diff(np.append(inside, high - low)), axis=0)
            levels = (count > 0).sum(axis=0)
        moments = _moments(w[low:high], np.broadcast_to(rank, w[low:high].shape), ry[low:high])
        out.append((part, float(x[low]), moments[0], np.zeros(w.shape[1], dtype=np.int64) if levels is None else levels, moments[1:]))
    moments = _moments(w, np.broadcast_to(x[:, None], w.shape), y)
    out.append((VALUES, float(x[0]), moments[0], np.zeros(w.shape[1], dtype=np.int64), moments[1:]))
    return out


def _chunks(rows: DataFrame, keys: Sequence[str], targets: int) -> DataFrame:
    """Parts of all chunks of rows sorted by (keys, _x); a chunk's first part carries its values and which targets each row has."""
    width = len(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seq = TaskContext.get().partitionId(), 0

        def begins_of(batch: pa.RecordBatch) -> np.ndarray:
            """Where groups begin."""
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for k in range(width):
                indices = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= indices[1:] != indices[:-1]
            return np.flatnonzero(new)

        def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal seq
            begins, x = begins_of(batch), batch.column(width).to_numpy()
            matrix = np.column_stack([batch.column(width + 1 + i).to_numpy(zero_copy_only=False) for i in range(2 * targets)]).astype(np.float64)
            at, found = [], []
            for low, high in zip(begins, np.append(begins[1:], len(x)), strict=True):
                values, y = x[low:high], matrix[low:high, :targets]
                for part, v, n, levels, moments in chunk_parts(values, y, matrix[low:high, targets:]):
                    packed = (values.tobytes(), np.packbits(~np.isnan(y), axis=1, bitorder="little").tobytes()) if part == FIRST else (None, None)
                    at.append(low)
                    found.append((place, seq, part, v, n, levels, *moments, *packed))
                seq += 1
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(columns[i], pa.int32()) for i in range(3)] + [pa.array(columns[3], pa.float64())]
            arrays += [pa.array([c.tolist() for c in columns[i]], pa.list_(pa.int64() if i < 6 else pa.float64())) for i in range(4, 11)]
            arrays += [pa.array(columns[i], pa.binary()) for i in (11, 12)]
            names = [*keys, *[c.split()[0] for c in _PARTS.split(", ")]]
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(width)), *arrays], names=names)

        for batch in batches:
            if batch.num_rows:
                yield summed(batch)

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _PARTS)


def _quantiles(parts: DataFrame, keys: Sequence[str], ahead: DataFrame, cuts: int, targets: int) -> DataFrame:
    """(keys, t, edges): the distinct quantiles k / ``cuts`` of the x values that have target t."""
    ranks = f"""filter(flatten(transform(sequence(0, {cuts}), k -> array(
        struct(k, 0 AS side, ((total - 1) * k) div {cuts} - ahead AS r), struct(k, 1 AS side, ((total - 1) * k + {cuts - 1}) div {cuts} - ahead AS r)))), s -> s.r >= 0 AND s.r < n)"""
    wanted = ahead.selectExpr("slice", "seq", "t", "total", f"inline({ranks})").groupBy("slice", "seq").agg(F.collect_list(F.struct("t", "k", "side", "r", "total")).alias("wanted"))
    data = parts.where(F.col("part") == FIRST).select(*keys, "slice", "seq", "xs", "marks").join(wanted, ["slice", "seq"]).select(*keys, "xs", "marks", "wanted")
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(len(keys))[i].as_py(), dtype=np.float64)
                marks = np.frombuffer(batch.column(len(keys) + 1)[i].as_py(), dtype=np.uint8).reshape(len(x), -1)
                asked = batch.column(len(keys) + 2)[i].values
                t, k, side, r, total = (asked.field(c).to_numpy() for c in range(5))
                value = np.zeros(len(t))
                for target in np.unique(t):
                    mine = t == target
                    value[mine] = x[(marks[:, target // 8] >> (target % 8)) & 1 == 1][r[mine]]
                where = pa.array(np.full(len(t), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(where) for c in range(len(keys))), pa.array(t), pa.array(k), pa.array(side), pa.array(total), pa.array(value)], names=[*keys, "t", "k", "side", "total", "x"])

    found = data.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", t int, k int, side int, total long, x double")
    low, high = (f"max(CASE WHEN side = {side} THEN x END)" for side in (0, 1))
    edges = found.groupBy(*keys, "t", "k").agg(F.expr(f"{low} + ({high} - {low}) * (max(((total - 1) * k) % {cuts}) / {float(cuts)}D) AS edge"))
    return edges.groupBy(*keys, "t").agg(F.expr("array_distinct(transform(array_sort(collect_list(struct(k, edge))), s -> s.edge)) AS edges"))


def correlation_grid(df: DataFrame, keys: Sequence[str], xs: Sequence[str], ys: Sequence[str], least: int = 3, cuts: int | None = None) -> DataFrame:
    """Spearman and Pearson correlation of every x with every y in each group, over the rows that have both.

    One row per (group, ``factor``, ``target_col``) that has rows, with their number ``n``;
    correlations are NULL below ``least`` rows and for constant values.  With ``cuts`` also ``distinct_count`` of
    the x values and ``edges``, their distinct quantiles k / ``cuts``.  NULL keys are a group; values must be finite or NULL.
    """
    base = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in (*xs, *ys)])
    base = materialize(base.withColumn("_id", F.monotonically_increasing_id()), "grid")
    # Factors that are missing in the same rows share their ranks of y: a count and two hashes of the row numbers tell.
    missing = base.agg(*[F.expr(f"struct(count_if(`{x}` IS NULL), bit_xor(IF(`{x}` IS NULL, xxhash64(_id), 0L)), sum(CAST(IF(`{x}` IS NULL, hash(_id), 0) AS long))) AS `{x}`") for x in xs]).first()
    patterns = list(dict.fromkeys(tuple(missing[x]) for x in xs))
    pattern_of = {x: patterns.index(tuple(missing[x])) for x in xs}
    shown = [next(x for x in xs if pattern_of[x] == m) for m in range(len(patterns))]

    tall = base.selectExpr(*keys, "_id", *[f"IF(`{x}` IS NULL, 0, 1) AS _m{m}" for m, x in enumerate(shown)],
                           "inline(array(" + ", ".join(f"struct({t} AS _t, `{y}` AS _y)" for t, y in enumerate(ys)) + "))").where("_y IS NOT NULL")
    ranked = ranks_in_place(tall, [*keys, "_t"], "_y", "_id", [f"_m{m}" for m in range(len(shown))], keep=["_id"])
    by_row = ranked.groupBy(F.col("_id").alias("_row")).agg(F.expr(
        "map_from_entries(collect_list(struct(_t, transform(ranks, r -> r.before + (r.ties + 1) / 2.0D)))) AS _ry"))
    of = range(len(ys))
    wide = base.join(by_row, F.col("_id") == F.col("_row")).selectExpr(
        *keys, "_id", *[f"`{x}`" for x in xs], *[f"`{y}` AS _y{t}" for t, y in enumerate(ys)], *[f"_ry[{t}] AS _r{t}" for t in of])
    long = wide.selectExpr(*keys, "_id", *[f"_y{t}" for t in of], *[f"_r{t}" for t in of], "inline(array(" + ", ".join(
        f"struct('{x}' AS factor, {pattern_of[x]} AS _p, `{x}` AS _x)" for x in xs) + "))").where("_x IS NOT NULL")
    keys = [*keys, "factor"]
    order = [*keys, "_x", "_id"]
    long = long.selectExpr(*keys, "_x", *[f"_y{t}" for t in of], *[f"_r{t}[_p] AS _r{t}" for t in of], "_id")
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(_chunks(long.repartitionByRange(slices, *order).sortWithinPartitions(*order), keys, len(ys)), "parts")

    each = parts.selectExpr(*keys, "slice", "seq", "part", "v", "posexplode(arrays_zip(n, levels, am, a2, bm, b2, ab)) AS (t, s)").selectExpr(*keys, "slice", "seq", "part", "v", "t", "s.*").where("n > 0")
    pair = Window.partitionBy(*keys, "t")
    ranks = each.where(F.col("part") != VALUES)
    ranks = ranks.withColumn("ahead", F.coalesce(F.sum("n").over(pair.orderBy("slice", "seq", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy(*keys, "t", F.col("part") == INNER, "v")
    whole = ranks.withColumns({"first": F.min("ahead").over(run), "size": F.sum("n").over(run)})
    # Inner runs have their ranks; of a run at an edge all parts share one.
    whole = whole.selectExpr(*keys, "t", "n", "bm", "b2", "ab", "a2", f"IF(part = {INNER}, ahead + am, first + (size + 1) / 2.0D) AS am", f"IF(part = {INNER}, levels, n / size) AS levels", "1 AS kind")
    values = each.where(F.col("part") == VALUES).selectExpr(*keys, "t", "n", "bm", "b2", "ab", "a2", "am", "0.0D AS levels", "0 AS kind")
    both = whole.union(values)
    one = Window.partitionBy(*keys, "t", "kind")
    both = both.withColumns({"A": F.sum(F.col("n") * F.col("am")).over(one) / F.sum("n").over(one), "B": F.sum(F.col("n") * F.col("bm")).over(one) / F.sum("n").over(one)})
    sums = both.groupBy(*keys, "t", "kind").agg(
        F.sum("n").alias("n"), F.sum("levels").alias("levels"), F.expr("sum(a2 + n * (am - A) * (am - A)) AS aa"), F.expr("sum(b2 + n * (bm - B) * (bm - B)) AS bb"), F.expr("sum(ab + n * (am - A) * (bm - B)) AS ab"))
    # Whether ranks differ at all is exact: equal ranks have a deviation of zero.
    figures = sums.groupBy(*keys, "t").agg(F.max("n").alias("n"), F.expr("max(CASE WHEN kind = 1 THEN CAST(round(levels) AS long) END) AS distinct_count"), *[
        F.expr(f"max(CASE WHEN kind = {kind} THEN {c} END) AS {c}{kind}") for kind in (0, 1) for c in ("aa", "bb", "ab")])
    moving = f"n >= {int(least)} AND aa1 > 0 AND bb1 > 0 AND distinct_count > 1"
    name = "CASE t " + " ".join(f"WHEN {t} THEN '{y}'" for t, y in enumerate(ys)) + " END AS target_col"
    out = figures.selectExpr(*keys, "t", name, "n", f"CASE WHEN {moving} THEN try_divide(ab1, sqrt(aa1) * sqrt(bb1)) END AS spearman_ic", f"CASE WHEN {moving} THEN try_divide(ab0, sqrt(aa0) * sqrt(bb0)) END AS pearson_ic", "distinct_count")
    if not cuts:
        return out.drop("t", "distinct_count")
    chunks = ranks.groupBy(*keys, "t", "slice", "seq").agg(F.min("ahead").alias("ahead"), F.sum("n").alias("n")).withColumn("total", F.sum("n").over(pair))
    edges = _quantiles(parts, keys, chunks, cuts, len(ys))
    matched = F.col("t") == F.col("_t")
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(edges.withColumnsRenamed({c: f"_{c}" for c in [*keys, "t"]}), matched, "left").drop("t", "_t", *[f"_{k}" for k in keys])
