"""Cumulative chat logs collapsed to their longest snapshots, then rendered.

A log often holds a conversation several times, each time with more turns.  Every
turn gets the rolling fingerprint of its conversation up to it: the exclusive or
of two 64-bit hashes of (place, role, text) over the turns so far.  A conversation
whose last fingerprint is a proper prefix's fingerprint of another one is dropped by an
anti-join, and of equal conversations the smallest id stays.

Places and fingerprints are running sums over blocks of ``BLOCK`` turn numbers plus the
totals of the blocks before, so a conversation of any length spreads over tasks.
Prefix fingerprints are made distinct before the join, so a first turn that a third
of all conversations share is one row there.

Each kept turn is rendered on its own; a conversation's segments in order of ``place``
are its training text.

Defined cases: rows without conversation or turn are left out; null role or text is
empty; repeated equal rows count once; different rows of one turn follow by role
and text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.scratch import materialize

BLOCK = 1024


def snapshots(turns: DataFrame) -> DataFrame:
    """(c, place, n, x, y, role, text): clean turns with conversation length and prefix fingerprints."""
    clean = turns.selectExpr("CAST(conv_id AS long) AS c", "CAST(turn AS long) AS turn", "coalesce(CAST(role AS string), '') AS role", "coalesce(CAST(text AS string), '') AS text")
    clean = clean.where("c IS NOT NULL AND turn IS NOT NULL").distinct().withColumn("block", F.expr(f"floor(turn / {BLOCK})"))
    clean = materialize(clean, "turns")
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    # One row per block of a conversation.
    counts = clean.groupBy("c", "block").count().select(
        "c", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"), F.sum("count").over(whole).alias("n"))
    order = Window.partitionBy("c", "block").orderBy("turn", "role", "text")
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = clean.join(counts, ["c", "block"]).withColumn("place", F.col("ahead") + F.row_number().over(order))
    hashed = placed.withColumns({"x": F.xxhash64(F.lit(1), "place", "role", "text"), "y": F.xxhash64(F.lit(2), "text", "role", "place")})
    running = materialize(
        hashed.withColumns({"x": F.expr("bit_xor(x)").over(inside), "y": F.expr("bit_xor(y)").over(inside)}).select("c", "block", "place", "n", "x", "y", "role", "text"), "running")
    totals = running.groupBy("c", "block").agg(F.max_by(F.struct("x", "y"), "place").alias("t"))
    carried = totals.select("c", "block", F.coalesce(F.expr("bit_xor(t.x)").over(before), F.lit(0)).alias("x0"), F.coalesce(F.expr("bit_xor(t.y)").over(before), F.lit(0)).alias("y0"))
    return running.join(carried, ["c", "block"]).selectExpr("c", "place", "n", "x ^ x0 AS x", "y ^ y0 AS y", "role", "text")


def maximal_conversations(table: DataFrame) -> DataFrame:
    """(c): ids of the conversations to keep, from stored :func:`snapshots`."""
    last = table.where("place = n").groupBy("n", "x", "y").agg(F.min("c").alias("c"))
    prefixes = table.where("place < n").select(F.col("place").alias("n"), "x", "y").distinct()
    return last.join(prefixes, ["n", "x", "y"], "left_anti").select("c")


def chat_segments(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, role, segment) of the maximal conversations."""
    table = materialize(snapshots(turns), "snapshots")
    kept = table.join(maximal_conversations(table), "c", "left_semi")
    return kept.selectExpr(
        "c AS conv_id", "place", "n AS n_turns", "role",
        r"concat(CASE WHEN place = 1 THEN '<|chat|>\n' ELSE '' END, '<|', role, '|>\n', text, '<|end|>\n', CASE WHEN place = n THEN '<|done|>\n' ELSE '' END) AS segment")


CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY c) AS n FROM t),
p AS (SELECT *, md5(string_agg(md5(role || chr(31) || text), ',') OVER (PARTITION BY c ORDER BY place)) AS k FROM o),
f AS (SELECT n, k, min(c) AS c FROM p WHERE place = n GROUP BY n, k),
kept AS (SELECT c FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = f.n AND p.k = f.k))
SELECT c AS conv_id, place, n AS n_turns, role,
  CASE WHEN place = 1 THEN '<|chat|>' || chr(10) ELSE '' END || '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)
    || CASE WHEN place = n THEN '<|done|>' || chr(10) ELSE '' END AS segment
FROM p WHERE c IN (SELECT c FROM kept)
"""
