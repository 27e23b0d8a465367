"""MinHash near-duplicates from bottom-k sketches of one hash function.

Every text becomes its set of word shingles, kept as 63-bit hashes of one
function; its sketch is the ``SKETCH`` smallest of them.  Inverted lists of
retained values generate overlaps, the sketch of the union estimates the
similarity of each candidate pair, and the full sets confirm it.

Lossless narrowing
    Two sets of the threshold similarity share at least ``LEAST_SHARED`` of 64
    retained values (expected 51 where one contains the other, standard deviation 3.2,
    and more otherwise; for sets that fit into the sketch the bound is exact).  So each text enters only the lists of its
    ``len - LEAST_SHARED + 1`` rarest retained values: two similar texts still
    meet in one.  Rarity comes from counts in ``RARITY_BUCKETS`` hashed
    buckets over all texts, an array of fixed size; it orders the work and
    has no influence on the result.

Hot lists
    Equal sets are one class from the start.  A list is first compared with
    its smallest member only (a star).  In ``HUB_ROUNDS`` more rounds members
    outside the list's largest component meet a hub inside and one outside it,
    other hubs in every list.  The pairs of a list that are left are those of
    members in different components whose distances to the list's first hub leave
    similarity possible, so a list of a third of all rows that hangs together
    costs a few comparisons per row.  If over ``LONG_REST`` members are outside,
    the list's members meet by their full sets instead: similar sets have their first common
    element, rarest first, so early in both that copies of one text, each changed
    in its own places, do not meet at what they share.  No list, bucket or partner count is capped.

Defined cases: rows without id are left out; rows that share an id are one
document; null, empty and blank texts have no shingle and are linked with
nothing; a text shorter than a shingle is one shingle; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.graph import components
from tickerloom.llm.text import bounded_batches, column_bytes, mix, positive, shingle_sets, small_batches
from tickerloom.scratch import materialize, temporary

SKETCH = 64
LEAST_SHARED = 35
RARITY_BUCKETS = 1 << 20
HUB_ROUNDS = 1
#: Lists with more members outside their largest component are compared by prefixes of full sets.
LONG_REST = 32
#: Of 128 one-bit bins, sets of similarity 0.8 differ in 12.8 on average (standard deviation 3.4), unrelated ones in 64.
DIGEST_BITS = 32
#: The union sketch must show at least this share: the threshold less five standard deviations.
ESTIMATE_SLACK = 0.25


def digest_of(values: np.ndarray) -> np.ndarray:
    """One bit of the smallest hash in each of 128 bins, as two longs."""
    least = np.zeros(128, dtype=np.uint64)
    least[(values & np.uint64(127)).astype(np.int64)[::-1]] = values[::-1]
    return np.packbits(((least >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(d, n, f, g, s): id, set size, fingerprint of the set, digest, sketch."""
    schema = "d long, n long, f long, g struct<x: long, y: long>, s array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, digests, sketches = [], [], [], []
            for values in shingle_sets(column_bytes(batch.column(1)), words):
                sizes.append(len(values))
                prints.append(int(np.bitwise_xor.reduce(mix(values, 9)).view(np.int64)) if len(values) else 0)
                digests.append(digest_of(values))
                sketches.append(positive(values[:SKETCH]))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sketches]))).astype(np.int32)
            marks = np.array(digests, dtype=np.int64).reshape(-1, 2)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.StructArray.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=["x", "y"]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["d", "n", "f", "g", "s"],
            )

    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).where("d IS NOT NULL")
    return source.mapInArrow(run, schema)


def prefix_length(size: int, percent: int) -> int:
    """How many of its rarest retained values a set of ``size`` shingles must offer."""
    kept = min(size, SKETCH)
    shared = -(-percent * size // 100) if size * 100 <= SKETCH * percent else min(LEAST_SHARED, kept)
    return kept - shared + 1


def _rarity(sets: DataFrame) -> Broadcast:
    """How many values of ``s`` fall into each of RARITY_BUCKETS hashed buckets."""
    rarity = np.zeros(RARITY_BUCKETS, dtype=np.int32)
    buckets = sets.select(F.explode("s").alias("v")).groupBy(F.expr(f"v & {RARITY_BUCKETS - 1}").alias("b")).count()
    counts = buckets.toArrow()  # at most RARITY_BUCKETS rows, whatever the table
    rarity[counts.column(0).to_numpy()] = np.minimum(counts.column(1).to_numpy(), np.iinfo(np.int32).max)
    return sets.sparkSession.sparkContext.broadcast(rarity)


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(v, d, n, g): the lists each class enters."""
    shared = _rarity(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            column = batch.column(3)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            at = at - at[0]
            sizes = batch.column(1).to_numpy()
            values, owners = [], []
            for i, size in enumerate(sizes.tolist()):
                own = flat[at[i]:at[i + 1]]
                order = np.lexsort((own, rarity[own & (RARITY_BUCKETS - 1)]))[: prefix_length(size, percent)]
                values.append(own[order])
                owners.append(np.full(len(order), i))
            if not values:
                continue
            owner = np.concatenate(owners)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values)), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), batch.column(2).take(pa.array(owner))],
                names=["v", "d", "n", "g"],
            )

    return sets.select("d", "n", "g", "s").mapInArrow(run, "v long, d long, n long, g struct<x: long, y: long>")


def _alike(n1: str, n2: str, g1: str, g2: str, percent: int, bits: int) -> str:
    """Whether sizes and digests leave the threshold possible; a digest differs in no more bits than the sets in elements."""
    differ = f"bit_count({g1}.x ^ {g2}.x) + bit_count({g1}.y ^ {g2}.y)"
    return (
        f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {differ} <= {bits} "
        f"AND {100 + percent} * ({differ}) <= {100 - percent} * ({n1} + {n2})"
    )


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, e): the share of common values in the sketch of each pair's union."""
    one, two = sets.selectExpr("d AS a", "s AS s1"), sets.selectExpr("d AS b", "s AS s2")
    union = f"slice(array_sort(array_union(s1, s2)), 1, {SKETCH})"
    share = f"size(array_intersect({union}, array_intersect(s1, s2))) / size({union})"
    return pairs.join(one, "a").join(two, "b").selectExpr("a", "b", f"{share} AS e")


def similarities(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union of the full shingle sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    both = pairs.join(texts.selectExpr("d AS a", "t AS t1"), "a").join(texts.selectExpr("d AS b", "t AS t2"), "b").select("a", "b", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            one, two = column_bytes(batch.column(2)), column_bytes(batch.column(3))
            for x, y in zip(shingle_sets(one, words), shingle_sets(two, words), strict=True):
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                total.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    return both.mapInArrow(run, "a long, b long, common long, total long")


def measured(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, lo, hi, ok) of (a, b, common, total): the distance as bounds, and whether the pair is similar."""
    return rows.selectExpr("a", "b", "1 - common / greatest(total, 1) AS lo", "1 - common / greatest(total, 1) AS hi", f"common > 0 AND 100 * common >= {percent} * total AS ok")


def full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``wanted`` (d, c, g) with the full shingle set ``s`` of each document d."""
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [positive(values) for values in shingle_sets(column_bytes(batch.column(3)), words)]
            if sets:
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["d", "c", "g", "s"])

    return texts.join(wanted, "d").select("d", "c", "g", "t").mapInArrow(run, "d long, c long, g struct<x: long, y: long>, s array<bigint>").dropDuplicates(["d"])


def prefix_pairs(sets: DataFrame, percent: int, alike: str) -> DataFrame:
    """(a, b): all similar pairs of different c in the stored table (d, c, g, s), and those that share an element as early.

    Similar sets of x and y elements share percent (x + y) / (100 + percent).  In one order of all
    elements their first common one has at most the rest before it; in the
    smaller set that is fewer than in the larger, where sizes may differ by the threshold.
    """
    shared = _rarity(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            column = batch.column(3)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            at = at - at[0]
            values, owners, places, sizes = [], [], [], np.diff(at)
            for i, size in enumerate(sizes.tolist()):
                own = flat[at[i]:at[i + 1]]
                order = np.lexsort((own, rarity[own & (RARITY_BUCKETS - 1)]))[: size - -(-percent * size // 100) + 1]
                values.append(own[order])
                owners.append(np.full(len(order), i))
                places.append(np.arange(len(order)))
            if not values:
                continue
            owner = np.concatenate(owners)
            mine = [batch.column(j).take(pa.array(owner)) for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), *mine, pa.array(sizes[owner].astype(np.int64)), pa.array(np.concatenate(places))], names=["v", "d", "c", "g", "n", "at"])

    offers = small_batches(sets).select("d", "c", "g", "s").mapInArrow(run, "v long, d long, c long, g struct<x: long, y: long>, n long, at long")
    offers = materialize(offers, "prefixes")
    larger = offers.select("v", *[F.col(x).alias(f"{x}2") for x in ("d", "c", "g", "n", "at")])
    # Of sets that are no larger than their partner, only these places can hold the first common element.
    smaller = offers.where(f"{2 * percent} * n <= {100 + percent} * (n - at)")
    met = smaller.join(larger, "v").where("c <> c2 AND (n < n2 OR n = n2 AND d < d2)").where(f"{percent} * (n + n2) <= {100 + percent} * least(n - at, n2 - at2)")
    return met.where(alike).selectExpr("least(d, d2) AS a", "greatest(d, d2) AS b")


def link_lists(postings: DataFrame, percent: int, confirm: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], bits: int = DIGEST_BITS) -> DataFrame:
    """Links (a, b) that connect what the pairs of each list connect.

    ``postings`` (v, d, n, g) is a stored table of lists v of members d with
    set size n and digest g, which differs in no more bits than the sets in
    elements and for similar sets in no more than ``bits``; ``confirm`` gives, for
    distinct pairs (a, b), bounds ``lo`` and ``hi`` of their Jaccard distance and ``ok`` where
    they are similar; ``sets`` adds to rows (d, c, g) the full set of d as an array ``s``.
    Candidates, and what ``confirm`` stores, go as soon as their links are stored.
    """
    spark = postings.sparkSession
    lists = postings.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "n", "g")).alias("h")).where("c > 1")
    shared = materialize(postings.join(lists.selectExpr("v", "h.d AS hd", "h.n AS hn", "h.g AS hg"), "v"), "shared")

    def links(pairs: DataFrame, label: str) -> DataFrame:
        with temporary(spark) as leave:
            return leave(materialize(confirm(materialize(pairs.distinct(), f"candidates-{label}")), f"links-{label}"))

    def linked(rows: DataFrame) -> DataFrame:
        return rows.where("ok").select("a", "b")

    def placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of each list with their component so far; those outside the list's largest component."""
        with temporary(spark) as leave:
            named = bounded.join(components(found).withColumnRenamed("node", "d"), "d", "left").drop("hd")
            named = named.withColumn("c", F.expr("coalesce(component, d)")).drop("component")
            main = named.groupBy("v", "c").count().groupBy("v").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count(F.lit(1)).alias("k"))
            named = leave(materialize(named.join(main.where("k > 1"), "v"), "placed"))
        return named, named.where("c <> main")

    star = links(shared.where("d <> hd").where(_alike("n", "hn", "g", "hg", percent, bits)).selectExpr("hd AS a", "d AS b"), "star")
    found = linked(star)
    # Jaccard distance obeys the triangle inequality: two members whose distances to their list's
    # hub differ by more than the threshold distance cannot be similar.
    least, most = (100 - percent) / 100, (100 - percent) / 100 + 1e-6
    bounds = star.selectExpr("a AS hd", "b AS d", "CAST(lo AS float) AS lo", "CAST(hi AS float) AS hi")
    bounded = shared.select("v", "d", "n", "g", "hd").join(bounds, ["hd", "d"], "left").selectExpr(
        "v", "d", "n", "g", "hd", f"coalesce(lo, IF(d = hd, 0, {least})) AS lo", "coalesce(hi, IF(d = hd, 0, 1)) AS hi")
    near_hub = f"lo - hi2 <= {most} AND lo2 - hi <= {most}"
    for turn in range(HUB_ROUNDS):
        members, rest = placed(found)
        # In every list another hub, drawn from the largest component and from outside it.
        drawn = F.min_by(F.struct("d", "n", "g", "c"), F.struct(F.xxhash64("v", "d", F.lit(turn)), "d")).alias("h")
        hubs = members.groupBy("v", F.expr("c = main").alias("inner")).agg(drawn).selectExpr("v", "h.d AS d2", "h.n AS n2", "h.g AS g2", "h.c AS c2")
        met = rest.join(hubs, "v").where("c <> c2").where(_alike("n", "n2", "g", "g2", percent, bits))
        found = found.union(linked(links(met.selectExpr("least(d2, d) AS a", "greatest(d2, d) AS b"), f"hubs-{turn}")))
    members, rest = placed(found)
    long = materialize(rest.groupBy("v").count().where(f"count > {LONG_REST}").select("v"), "long")
    left = rest.join(long, "v", "left_anti").select("v", *[F.col(x).alias(f"{x}2") for x in ("d", "n", "g", "c", "lo", "hi")])
    # Of two members outside the main component, only the smaller meets the larger.
    alike = _alike("n", "n2", "g", "g2", percent, bits)
    last = members.join(left, "v").where("c <> c2 AND (c = main OR d < d2)").where(near_hub).where(alike)
    last = last.selectExpr("least(d, d2) AS a", "greatest(d, d2) AS b")
    wanted = members.join(long, "v", "left_semi").select("d", "c", "g").dropDuplicates(["d"])
    early = prefix_pairs(materialize(sets(materialize(wanted, "wanted")), "full-sets"), percent, alike)
    return found.union(linked(links(last.union(early), "rest")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document."""
    table = materialize(sketch_table(docs, id_col, text_col, words), "sketches")
    classes = table.where("n > 0").groupBy("f", "n").agg(F.min("d").alias("r"))
    with temporary(docs.sparkSession) as leave:
        linked = leave(materialize(_linked_classes(table, classes, docs, id_col, text_col, words, percent), "components"))
    owner = classes.join(linked.withColumnRenamed("node", "r"), "r", "left").selectExpr("f", "n", "coalesce(component, r) AS c")
    named = table.select("d", "n", "f").join(owner, ["f", "n"], "left")
    return (
        named.groupBy("d").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("c", "d")).alias("component_id"))
        .selectExpr("d AS doc_id", "n_shingles", "component_id", "d = component_id AS kept")
    )


def _linked_classes(table: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes (f, n, r: smallest id) of the stored sketches that are linked with others."""
    reps = materialize(table.where("n > 0").join(classes, ["f", "n"]).where("d = r").select("d", "n", "g", "s").dropDuplicates(["d"]), "classes")

    postings = materialize(_postings(reps, percent), "postings")

    def confirm(pairs: DataFrame) -> DataFrame:
        guess = materialize(estimated(pairs, reps), "estimates")
        close = guess.where(f"e >= {percent / 100 - ESTIMATE_SLACK}").select("a", "b")
        # The estimate lies within five standard deviations of the similarity.
        far = guess.where(f"e < {percent / 100 - ESTIMATE_SLACK}").selectExpr("a", "b", "greatest(1 - e - 0.3125D, 0D) AS lo", "1D AS hi", "false AS ok")
        return measured(similarities(close, docs, id_col, text_col, words).distinct(), percent).union(far)

    return components(link_lists(postings, percent, confirm, lambda wanted: full_sets(wanted, docs, id_col, text_col, words)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; rows without id stay."""
    with temporary(docs.sparkSession) as leave:
        dropped = near_duplicates(docs, id_col, text_col, words, percent).where("NOT kept").select(F.col("doc_id").alias("_d"))
        dropped = leave(materialize(dropped, "dropped"))
    key = F.col(id_col).cast("long")
    kept = docs.join(dropped, key == F.col("_d"), "left_anti")
    repeated = materialize(docs.groupBy(key.alias("_d")).count().where("_d IS NOT NULL AND count > 1").select("_d"), "repeated")
    once = kept.join(repeated, key == F.col("_d"), "left_semi").dropDuplicates([id_col])
    return kept.join(repeated, key == F.col("_d"), "left_anti").union(once)
