"""Repeated and near-repeated paragraphs by MinHash banding.

Texts are cut into content-defined paragraphs (``text.paragraphs``).  A
paragraph's class is the hash of its words without case of A-Z.  Classes collide
in one of the bands of their MinHash over five-word shingles; ``tuned`` picks
the fewest bands that find a pair at the threshold with the wanted probability.
Colliding classes are confirmed by exact Jaccard similarity, linked to components,
and all but the first occurrence (by document, then place) of a component go.

Only band keys that two different classes share are kept after one shuffle, and
equal paragraphs of a batch count once before it, so a passage in a third of all
documents costs one row per batch.  Occurrences meet their component's first one
by a join, never in one group.

Defined cases: rows without id are never changed; rows that share an id are one
document; paragraphs under ``LEAST_WORDS`` words never repeat; null and empty texts
have no paragraph; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.graph import components
from tickerloom.llm.near_dedup import link_lists, measured
from tickerloom.llm.text import Words, bounded_batches, chunks, column_bytes, mix, paragraphs, positive, powers
from tickerloom.scratch import materialize, temporary

LEAST_WORDS = 6
SHINGLE = 5
#: Wanted chance that two paragraphs at the threshold become candidates.
RECALL = 0.99999


def tuned(percent: int, recall: float = 0.99, most: int = 40) -> tuple[int, int]:
    """(bands, rows): the fewest bands with that recall at the threshold, then the most rows per band."""
    for bands in range(1, most):
        fitting = [rows for rows in range(1, 9) if 1 - (1 - (percent / 100) ** rows) ** bands >= recall]
        if fitting:
            return bands, max(fitting)
    raise ValueError("no banding reaches the recall")


class Cut:
    """Paragraphs of some texts: owner, number within it, class, byte range, and MinHash input."""

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts)
        last = paragraphs(words, LEAST_WORDS)
        self.first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
        self.size = last + 1 - self.first
        self.owner = words.text[self.first] if len(last) else last
        self.number = np.arange(len(last)) - np.searchsorted(self.owner, self.owner)
        place = np.arange(len(words.hash)) - np.repeat(self.first, self.size)
        if len(last):
            self.key = positive(mix(np.add.reduceat(mix(words.hash, 5) * powers(int(self.size.max()))[place], self.first), 6))
        else:
            self.key = np.zeros(0, dtype=np.int64)
        self.eligible = self.size >= LEAST_WORDS

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles inside eligible paragraphs, with the number of their paragraph."""
        values, at = self.words.shingles(SHINGLE)
        unit = np.repeat(np.arange(len(self.first)), self.size)
        inside = (unit[at] == unit[np.minimum(at + SHINGLE - 1, len(unit) - 1)]) & self.eligible[unit[at]] if len(at) else np.zeros(0, dtype=bool)
        return values[inside], unit[at[inside]]


def _source(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).selectExpr("CAST(doc_id AS long) AS d", "CAST(text AS string) AS t").where("d IS NOT NULL AND t IS NOT NULL")


def _occurrences(docs: DataFrame) -> DataFrame:
    """(d, p, k): document, paragraph number, class of every eligible paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), column_bytes(batch.column(1))
            for a, b in chunks(texts):
                cut = Cut(texts[a:b])
                e = cut.eligible
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][cut.owner[e]]), pa.array(cut.number[e].astype(np.int32)), pa.array(cut.key[e])], names=["d", "p", "k"])

    return _source(docs).mapInArrow(run, "d long, p int, k long")


def _bands(docs: DataFrame, percent: int) -> DataFrame:
    """(v, d): band key and class, each pair once per batch."""
    bands, rows = tuned(percent, RECALL, 400)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, classes = column_bytes(batch.column(1)), [], []
            for a, b in chunks(texts):
                cut = Cut(texts[a:b])
                values, unit = cut.shingles()
                if not len(unit):
                    continue
                begin = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
                own = cut.key[unit[begin]]
                for band in range(bands):
                    key = np.full(len(own), band, dtype=np.uint64)
                    for row in range(rows):
                        key = mix(key ^ np.minimum.reduceat(mix(values, 20 + band * rows + row), begin))
                    keys.append(positive(key))
                    classes.append(own)
            if keys:
                v, d = np.concatenate(keys), np.concatenate(classes)
                order = np.lexsort((d, v))
                v, d = v[order], d[order]
                new = np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(v[new]), pa.array(d[new])], names=["v", "d"])

    return _source(docs).mapInArrow(run, "v long, d long")


def odd_sketches(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per run of ``values``, one flipped per value: two sketches differ in no more bits than their sets in elements."""
    flips = np.uint64(1) << (values.view(np.uint64) & np.uint64(63))
    upper = (values & 64) > 0
    return tuple(np.bitwise_xor.reduceat(np.where(side, flips, np.uint64(0)), begin).view(np.int64) for side in (upper, ~upper))


def wanted_sets(cut: Cut, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, begin, values): each class of ``wanted`` that stands in ``cut`` once, with its sorted shingles from ``begin`` on."""
    values, unit = cut.shingles()
    classes, first = np.unique(cut.key[cut.eligible], return_index=True)
    mine = np.full(len(cut.key), -1)
    mine[np.flatnonzero(cut.eligible)[first]] = np.where(np.isin(classes, wanted), np.arange(len(classes)), -1)
    of = mine[unit]
    values, of = values[of >= 0], of[of >= 0]
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (values[1:] != values[:-1])))[: len(of)]
    values, of = values[new], of[new]
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))[: len(of)])
    return classes[of[begin]], begin, positive(values)


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, s, x, y): shingle set and odd sketch of each class in ``wanted`` (d, k: a document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = column_bytes(batch.column(1)), batch.column(2)
            for a, b in chunks(texts):
                # Equal classes have equal sets, whichever text of the chunk they are taken from.
                keys, begin, values = wanted_sets(Cut(texts[a:b]), asked.slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
                if not len(keys):
                    continue
                sets = pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(keys), sets, *map(pa.array, odd_sketches(values, begin))], names=["k", "s", "x", "y"])

    named = wanted.groupBy("d").agg(F.collect_set("k").alias("c"))  # classes of one document
    return _source(docs).join(named, "d").select("d", "t", "c").mapInArrow(run, "k long, s array<bigint>, x long, y long").dropDuplicates(["k"])


def repeated_paragraphs(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, paragraph, component_id, kept_doc_id, kept_paragraph, class): the paragraphs to remove."""
    units = materialize(_occurrences(docs), "paragraphs")
    with temporary(docs.sparkSession) as leave:
        linked = leave(materialize(_linked_classes(docs, units, percent), "components")).selectExpr("node AS k", "component AS c")
    placed = units.join(linked, "k", "left").selectExpr("d", "p", "k", "coalesce(c, k) AS c")
    first = placed.groupBy("c").agg(F.min(F.struct("d", "p")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(first, "c").where("d <> f.d OR p <> f.p").selectExpr(
        "d AS doc_id", "p AS paragraph", "c AS component_id", "f.d AS kept_doc_id", "f.p AS kept_paragraph", "k AS class")


def _linked_classes(docs: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes of ``units`` (d, p, k) that are linked with others."""
    by_key = Window.partitionBy("v")
    with temporary(docs.sparkSession) as leave:
        met = _bands(docs, percent).withColumns({"lo": F.min("d").over(by_key), "hi": F.max("d").over(by_key)}).where("lo <> hi")
        met = materialize(met.select("v", "d").distinct(), "met")
        colliding = met.select(F.col("d").alias("k")).distinct()
        wanted = units.join(colliding, "k").groupBy("k").agg(F.min("d").alias("d"))
        sets = leave(materialize(_shingle_sets(docs, wanted), "shingle-sets"))
        # Sizes and sketches join only the keys that different classes share.
        lists = leave(materialize(met.join(sets.selectExpr("k AS d", "CAST(size(s) AS long) AS n", "struct(x, y) AS g"), "d").select("v", "d", "n", "g"), "lists"))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.selectExpr("k AS a", "s AS s1"), "a").join(sets.selectExpr("k AS b", "s AS s2"), "b")
        sizes = both.selectExpr("a", "b", "size(s1) + size(s2) AS n", "size(array_intersect(s1, s2)) AS common")
        return measured(sizes.selectExpr("a", "b", "common", "n - common AS total"), percent)

    def full(wanted: DataFrame) -> DataFrame:
        return wanted.join(sets.selectExpr("k AS d", "s"), "d").select("d", "c", "g", "s")

    return components(link_lists(lists, percent, confirm, full, bits=128))


def cut_out(text: bytes, gone: set[tuple[int, int]]) -> bytes:
    """``text`` without the paragraphs (number, class) in ``gone``; each reaches to the start of the next one."""
    cut = Cut([text])
    bad = [(p, k) in gone for p, k in zip(cut.number.tolist(), cut.key.tolist(), strict=True)]
    if not any(bad):
        return text
    begin = cut.words.start[cut.first]
    end = np.append(begin[1:], len(text))
    begin[0] = 0
    return b"".join(text[x:y] for x, y, out in zip(begin, end, bad, strict=True) if not out).rstrip() if not all(bad) else b""


def without_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with repeated paragraphs cut out of ``text`` and ``n_chars`` counted anew; documents left empty by that go."""
    with temporary(docs.sparkSession) as leave:
        removed = leave(materialize(repeated_paragraphs(docs, percent), "removed"))
    gone = removed.groupBy("doc_id").agg(F.collect_set(F.struct("paragraph", "class")).alias("_gone")).withColumnRenamed("doc_id", "_of")
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("_of"), "left").drop("_of")
    schema, names = docs.schema, docs.columns
    text_at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            found = batch.column(len(names))
            if found.null_count == len(found):
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            texts = columns[text_at].to_pylist()
            counts = columns[count_at].to_pylist() if count_at is not None else None
            keep = np.ones(len(texts), dtype=bool)
            for i, pairs in enumerate(found.to_pylist()):
                if pairs and texts[i]:
                    texts[i] = cut_out(texts[i].encode(), {(x["paragraph"], x["class"]) for x in pairs}).decode()
                    keep[i] = texts[i] != ""
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if counts is not None:
                columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, schema)
