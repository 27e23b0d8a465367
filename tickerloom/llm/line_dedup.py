"""Lines that stand in several documents, kept in the first of them only.

Lines are exploded with their position, reduced to a key (stripped of ASCII white
space, A-Z in lower case) and hashed to 128 bits.  A key of at least ``LEAST_CHARS``
code points that at least ``least_docs`` documents hold loses all its lines except
those of the smallest document id.  What is left is put together by position.

Everything is DataFrame functions.  Keys are counted with a map-side combine, so a
line that a third of all rows hold is one row per task.  The repeated keys are
stored and meet the lines again in one pass: a key with over ``1 / HOT`` of all
repeated lines is one of fewer than ``HOT`` such keys, which are broadcast; the others
are joined by shuffle, each with at most that share of the rows.  Only numbers travel
with the lines; texts are shuffled once, as the rows of their documents.

Defined cases: rows without an id are left out; null and empty texts are one empty
line; every row gives a row; rows that share an id are one document when
documents are counted, and each keeps or loses its own lines; ids are compared as long
numbers; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.scratch import materialize

LEAST_DOCS = 2
LEAST_CHARS = 10
#: Keys above this fraction (one in HOT) of the repeated lines are joined by broadcast.
HOT = 1000
_BLANKS = " \t\n\x0b\f\r"


def _rows(docs: DataFrame) -> DataFrame:
    """(d, h, lines): a row of the table is known by its id and the hash of its text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return texts.where("d IS NOT NULL").select("d", F.xxhash64("t").alias("h"), F.split("t", "\n", -1).alias("lines"))


def _keys(rows: DataFrame, least_chars: int) -> DataFrame:
    """(d, h, place, x, y): the lines long enough to count, with both halves of their key's hash."""
    lines = rows.select("d", "h", F.posexplode("lines").alias("place", "line"))
    keyed = lines.select("d", "h", "place", F.translate(F.trim("line", F.lit(_BLANKS)), string.ascii_uppercase, string.ascii_lowercase).alias("key"))
    return keyed.where(F.length("key") >= least_chars).select("d", "h", "place", F.xxhash64("key").alias("x"), F.xxhash64(F.lit(1), "key").alias("y"))


def repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(x, y, n, first): hash, number of lines and smallest document of each key that enough documents hold."""
    keys = _keys(_rows(docs), least_chars)
    if least_docs <= 2:
        # Two documents hold a key exactly if its smallest and largest id differ.
        enough = "true" if least_docs < 2 else "first < last"
        return keys.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last")).where(enough).drop("last")
    by_document = keys.groupBy("x", "y", "d").agg(F.count(F.lit(1)).alias("n"))
    return by_document.groupBy("x", "y").agg(F.sum("n").alias("n"), F.min("d").alias("first"), F.count(F.lit(1)).alias("held")).where(F.col("held") >= least_docs).drop("held")


def _dropped(rows: DataFrame, repeated: DataFrame, least_chars: int) -> DataFrame:
    """(d, h, gone): places of the lines to drop, per row that has any."""
    bound = (repeated.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = repeated.where(F.col("n") > bound).select("x", "y", F.col("first").alias("now"))
    cold = repeated.where(F.col("n") <= bound).select("x", "y", F.col("first").alias("later"), F.lit(False).alias("settled"))
    lines = _keys(rows, least_chars).join(F.broadcast(hot), ["x", "y"], "left")
    # Lines of hot keys have their answer and go through the shuffle spread by place, where they meet nothing.
    routed = lines.selectExpr("d", "h", "place", "now", "IF(now IS NULL, x, xxhash64(d, h, place)) AS x", "y", "now IS NOT NULL AS settled")
    found = routed.join(cold, ["x", "y", "settled"], "left").where("d > coalesce(now, later)")
    return found.groupBy("d", "h").agg(F.collect_set("place").alias("gone"))


def without_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each row's text without the lines that an earlier document holds."""
    repeated = materialize(repeated_lines(docs, least_docs, least_chars), "repeated_lines")
    rows = _rows(docs)
    joined = rows.join(_dropped(rows, repeated, least_chars), ["d", "h"], "left")
    return joined.selectExpr(
        "d AS doc_id", "CAST(size(lines) AS long) AS n_lines", "CAST(coalesce(size(gone), 0) AS long) AS n_dropped",
        r"array_join(IF(gone IS NULL, lines, transform(array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i))), '\n') AS text")


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of :func:`without_repeated_lines`."""
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = """
WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS d, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
exploded AS (SELECT d, r, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM exploded),
repeated AS (SELECT k, min(d) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT d) >= 2),
judged AS (SELECT keyed.*, coalesce(keyed.d > repeated.first_doc, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT d AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY d, r
"""
