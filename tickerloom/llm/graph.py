"""Connected components of a link table by alternating large-star and small-star steps.

Every step is one map-side combined minimum and one join; nothing is gathered
per component, so a component may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.scratch import discard, materialize, release_shuffles


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
    return moved.union(least.select("u", "m"))


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored distinct edges and a fingerprint of their set."""
    stored = materialize(edges.distinct(), "edges")
    mark = stored.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return stored, tuple(mark)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b long): the smallest node it reaches.

    Nulls and self-links are ignored; repeated links count once; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, mark = _stored(edges)
    while True:
        before = edges
        edges, now = _stored(_small_star(_large_star(before).where("u <> v")))
        discard(before)
        release_shuffles(edges.sparkSession)
        if now == mark:
            break
        mark = now
    return edges.selectExpr("u AS node", "v AS component").union(edges.selectExpr("v", "v")).distinct()
