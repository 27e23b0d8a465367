"""Approximate nearest neighbours by multiprobe p-stable hashing.

``TABLES`` tables hash a vector to ``FUNCTIONS`` slots floor((a.x + b) / w) of
Gaussian, hence 2-stable, projections a.  w is the root mean square spread of the
data along a random direction, b is random, and slots are clamped to ``SLOTS``
values, so a table has at most SLOTS^FUNCTIONS buckets whatever the table's size.

A query does not visit its own bucket only.  Two vectors at distance r = c sqrt(2) s,
with s the data's root mean square length around its mean, correlate by 1 - c^2.  So a
neighbour's projection is normal around (1 - c^2) times the query's, which gives each
slot's chance, and by products over the functions each bucket's.  Buckets
are visited in falling order of that chance until the visited ones hold a
neighbour with probability ``SUCCESS`` per table, and in the first table also until
at least ``4 k`` vectors were seen.  c is ``NEAR``; mean and s cover all vectors.

Candidates of all tables are reranked by exact distances.  A bucket's vectors and
probing queries meet in groups of bounded size: large buckets are split by hash,
both on the vectors' and on the queries' side, and each group returns at most k
rows per query, so no candidate list is ever shuffled.

Components of any finite size are handled; a distance beyond the range of doubles is infinite.
Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do rows without id.  Rows that share
an id are one vector (the first by value).  Equal distances go to the smaller id.
Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.scratch import materialize

TABLES = 6
FUNCTIONS = 10
SLOTS = 2
SUCCESS = 0.36
NEAR = 0.8
GROUP_VECTORS = 4096
GROUP_QUERIES = 2048


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): finite, non-zero vectors with an id, as doubles."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where("id IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists(x, v -> v <> 0)")
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``y``; squares that would leave the range of doubles are scaled first."""
    with np.errstate(over="ignore"):
        squares = ((x - y) ** 2).sum(axis=1)
        out = np.sqrt(squares)
        odd = np.flatnonzero(~((squares > 1e-280) & (squares < 1e280)))
        if len(odd):
            half = x[odd] / 2 - y / 2
            most = np.maximum(np.abs(half).max(axis=1), 5e-324)
            out[odd] = most * np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)) * 2
    return out


class Hashing:
    """Random projections and the data's scale.

    Vectors are multiplied by ``scale``, a power of two that brings the largest component to about 1, so that
    neither projections nor the data's moments leave the range of doubles.
    """

    def __init__(self, mean: np.ndarray, spread: float, scale: float = 1.0):
        rng = np.random.default_rng(11)
        self.mean, self.width, self.scale = mean, max(spread, 1e-300), scale
        self.directions = rng.normal(size=(TABLES, FUNCTIONS, len(mean)))
        self.shift = rng.uniform(0, 1, size=(TABLES, FUNCTIONS))
        self.weights = SLOTS ** np.arange(FUNCTIONS)
        self.codes = np.array(list(itertools.product(range(SLOTS), repeat=FUNCTIONS)))[:, ::-1]

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, functions): projections around the mean, in slot widths."""
        return np.einsum("nd,tfd->ntf", (x * self.scale - self.mean) / self.width, self.directions)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        slots = np.clip(np.floor(self.projected(x) + self.shift + SLOTS / 2 - 0.5), 0, SLOTS - 1).astype(np.int64)
        return slots @ self.weights

    def probes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, table, buckets in falling order of success); empty buckets are skipped."""
        likeness = 1 - NEAR**2
        borders = np.arange(1, SLOTS) - SLOTS / 2 + 0.5 - self.shift[..., None]
        cdf = np.frompyfunc(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), 1, 1)
        below = cdf((borders - likeness * self.projected(x)[..., None]) / math.sqrt(1 - likeness**2)).astype(float)
        slot = np.diff(np.concatenate((np.zeros((*below.shape[:-1], 1)), below, np.ones((*below.shape[:-1], 1))), axis=-1), axis=-1)
        for row, table in itertools.product(range(len(x)), range(TABLES)):
            chance = slot[row, table, np.arange(FUNCTIONS), self.codes].prod(axis=1)
            order = np.argsort(-chance, kind="stable")
            stop = np.searchsorted(np.cumsum(chance[order]), SUCCESS) + 1
            if table == 0:
                stop = max(stop, np.searchsorted(np.cumsum(sizes[table, order]), least) + 1)
            order = order[:stop]
            yield row, table, order[sizes[table, order] > 0]


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest found rows of ``table``, itself left out."""
    spark = table.sparkSession
    stored = materialize(usable(table, id_col, vector_col), "vectors")
    common = stored.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    length = F.size("x") == (common["w"] if common else 0)
    vectors, asked = stored.where(length), usable(queries, id_col, vector_col).where(length)
    out = "query_id long, rank int, vec_id long, score double"
    largest = vectors.agg(F.max(F.expr("aggregate(x, 0.0D, (a, v) -> greatest(a, abs(v)))"))).first()[0]
    # Vectors of usual size are left as they are.
    power = -math.frexp(largest)[1] if largest and not 1e-100 < largest < 1e100 else 0
    scale = math.ldexp(1.0, max(min(power, 1000), -1000))
    parts = vectors.select(F.posexplode("x").alias("i", "v")).withColumn("v", F.col("v") * F.lit(scale)).groupBy("i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()  # one row per dimension
    if not parts:
        return spark.createDataFrame([], out)
    mean = np.zeros(len(parts))
    for r in parts:
        mean[r["i"]] = r["m"]
    spread = math.sqrt(sum(r["s"] for r in parts))
    hashing = spark.sparkContext.broadcast(Hashing(mean, spread, scale))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = hashing.value.buckets(_stack(batch.column(1)))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(found[:, t]), batch.column(0), batch.column(1)], names=["t", "b", "id", "x"])

    postings = vectors.mapInArrow(hashed, "t int, b long, id long, x array<double>")
    sizes = np.zeros((TABLES, SLOTS**FUNCTIONS), dtype=np.int64)
    for row in postings.groupBy("t", "b").count().toLocalIterator():  # at most one row per bucket, a fixed number
        sizes[row["t"], row["b"]] = row["count"]
    known = spark.sparkContext.broadcast(sizes)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows, tables, codes = [], [], []
            for row, t, found in hashing.value.probes(_stack(batch.column(1)), known.value, 4 * k + 1):
                rows.append(np.full(len(found), row))
                tables.append(np.full(len(found), t, np.int32))
                codes.append(found)
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tables)), pa.array(np.concatenate(codes)), batch.column(0).take(row)], names=["t", "b", "id"])

    probes = materialize(asked.mapInArrow(probing, "t int, b long, id long"), "probes")
    asks = np.zeros_like(sizes)
    for row in probes.groupBy("t", "b").count().toLocalIterator():
        asks[row["t"], row["b"]] = row["count"]
    # Fixed-size plan: buckets share a group up to its size, larger ones are split.
    plan, group, filled = [], 0, 0
    for t in range(TABLES):
        for b in np.flatnonzero((sizes[t] > 0) & (asks[t] > 0)).tolist():
            splits, query_splits = -(-int(sizes[t, b]) // GROUP_VECTORS), -(-int(asks[t, b]) // GROUP_QUERIES)
            if filled and (filled + sizes[t, b] > GROUP_VECTORS or splits * query_splits > 1):
                group, filled = group + 1, 0
            plan.append((t, b, group, splits, query_splits))
            filled += int(sizes[t, b])
            if splits * query_splits > 1:
                group, filled = group + splits * query_splits, 0
        group, filled = group + 1, 0
    placed = F.broadcast(spark.createDataFrame(plan, "t int, b long, first long, vs long, qs long")) if plan else None
    if placed is None:
        return spark.createDataFrame([], out)
    left = postings.join(placed, ["t", "b"]).select(
        F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "first", "qs", "vs", "b", "id", "x"
    ).selectExpr("first + pmod(xxhash64(id), vs) * qs + q AS g", "b", "id", "x")
    wanted = probes.join(placed, ["t", "b"]).select(
        F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"), "first", "qs", "b", "id"
    ).selectExpr("first + v * qs + pmod(xxhash64(id), qs) AS g", "b", "id").join(asked, "id").select("g", "b", "id", "x")

    def ranked(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        groups = {b: rows for b, rows in queries.groupby("b")} if len(queries) else {}
        for b, rows in vectors.groupby("b"):
            if b not in groups:
                continue
            ids, x = rows["id"].to_numpy(), np.stack(rows["x"].to_numpy())
            asking = groups[b]
            for query, y in zip(asking["id"].to_numpy(), asking["x"], strict=True):
                distance = distances(x, y)
                other = np.flatnonzero(ids != query)
                best = other[np.lexsort((ids[other], distance[other]))[:k]]
                parts.append((np.full(len(best), query), ids[best], distance[best]))
        if not parts:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        query, vec, distance = (np.concatenate(c) for c in zip(*parts, strict=True))
        # Within the group only the k best of a query go on.
        order = np.lexsort((vec, distance, query))
        query, vec, distance = query[order], vec[order], distance[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": distance})[place < k]

    found = left.groupBy("g").cogroup(wanted.groupBy("g")).applyInPandas(ranked, "query_id long, vec_id long, score double")
    # At most k rows come from each group; the best of them are few per query.
    best = found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("r"))
    return best.select("query_id", F.posexplode("r").alias("p", "r")).selectExpr("query_id", "CAST(p + 1 AS int) AS rank", "r.vec_id AS vec_id", "r.score AS score")
