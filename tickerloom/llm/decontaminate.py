"""Benchmark passages in documents by SimHash of item-sized windows.

An item of m words can only lie in a document where a window of m words (the
whole text, if shorter) resembles it.  The steps are

1. windows: every window of each item length whose five-word shingles, by
   weight, occur for at least the threshold's share among the shingles of any
   item (a hashed bitmap of fixed size; a window of the threshold similarity always
   passes).  Overlapping windows form regions, only they are kept;
2. fingerprints: 64-bit SimHash of a window's words;
3. search: fingerprints are cut into ten blocks of 6 or 7 bits.  If two differ in at
   most ``RADIUS`` bits, one block differs in at most one, so items are
   indexed under every block value within that distance (74 rows an item) and windows under their
   own: a join on (length, block, value) misses no fingerprint within the radius.
   Windows at exactly 0.8 differ in 8 to 9 bits on average, so RADIUS has a wide margin;
4. check: the exact weighted Jaccard similarity of the shingle multisets, where a
   shingle weighs its number of bytes, must reach the threshold.

The item index is stored before it is joined, so Spark sees its real size when it chooses the
join; what is always broadcast is the bitmap and the list of distinct item lengths.

Defined cases: rows without id, null and empty texts and items of fewer than five
words take no part; rows that share an id are one document; repeated items match
under each of their ids; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.text import Words, bounded_batches, chunks, column_bytes
from tickerloom.scratch import materialize

SHINGLE = 5
PERCENT = 80
RADIUS = 19
BITMAP = 1 << 24
#: (first bit, number of bits) of the blocks of a fingerprint; more than RADIUS / 2 blocks, so one of them differs in one bit at most.
BLOCKS = [(7 * i, 7) for i in range(4)] + [(28 + 6 * i, 6) for i in range(6)]
_SLICE = 1 << 13


def _slots(values: np.ndarray) -> np.ndarray:
    return (values % np.uint64(BITMAP)).astype(np.int64)


def fingerprints(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows words[a:a + size] for a in ``at``."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8)).reshape(-1, 64).astype(np.int32) * 2 - 1
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits(total[at + size] - total[at] > 0, axis=1).view("<i8").ravel()


def shingle_weights(words: list[bytes]) -> Counter:
    """Weight of each distinct shingle times its number of occurrences, keyed by (shingle, occurrence)."""
    out, seen = {}, Counter()
    for i in range(len(words) - SHINGLE + 1):
        shingle = b" ".join(words[i:i + SHINGLE])
        out[shingle, seen[shingle]] = len(shingle)
        seen[shingle] += 1
    return Counter(out)


def similarity(a: list[bytes], b: list[bytes]) -> float:
    x, y = shingle_weights(a), shingle_weights(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def _item_table(items: DataFrame) -> DataFrame:
    """(i, m, f, w): item, number of words, fingerprint, lower-case words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column(1))
            keep, sizes, marks, words_out = [], [], [], []
            for i, text in enumerate(texts):
                words = Words([text])
                if len(words.hash) >= SHINGLE:
                    keep.append(i)
                    sizes.append(len(words.hash))
                    marks.append(int(fingerprints(words.hash, np.array([0]), len(words.hash))[0]))
                    words_out.append(b" ".join(words.buffer[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(words_out, pa.binary())],
                names=["i", "m", "f", "w"])

    source = items.selectExpr("CAST(item_id AS long) AS i", "CAST(text AS string) AS t").where("i IS NOT NULL AND t IS NOT NULL")
    return source.mapInArrow(run, "i long, m long, f long, w binary")


def _bitmap(items: DataFrame) -> np.ndarray:
    """Packed bits of the items' shingles; tasks send the slices of it that they have set, which are OR-ed slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP, dtype=bool)
        for batch in batches:
            bits[_slots(Words(column_bytes(batch.column(0))).shingles(SHINGLE)[0])] = True
        packed = np.packbits(bits).reshape(-1, _SLICE // 8)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed[s].tobytes() for s in used], pa.binary())], names=["s", "bits"])

    def united(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, dtype=np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({"s": table.column("s").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    out = np.zeros((BITMAP // _SLICE, _SLICE // 8), dtype=np.uint8)
    # At most BITMAP / _SLICE rows, 2 MB in all.
    for row in items.select("w").mapInArrow(run, "s long, bits binary").groupBy("s").applyInArrow(united, "s long, bits binary").collect():
        out[row["s"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.ravel()


def _covered(weight: np.ndarray, hit: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Starts of windows of ``size`` words whose hit shingles have that share of the weight."""
    window = size - SHINGLE + 1
    if window > len(weight):
        return np.zeros(0, dtype=np.int64)
    all_sum, hit_sum = (np.concatenate(([0], np.cumsum(x))) for x in (weight, weight * hit))
    return np.flatnonzero(100 * (hit_sum[window:] - hit_sum[:-window]) >= percent * (all_sum[window:] - all_sum[:-window]))


def _sizes_for(n: int, sizes: list[int]) -> list[int]:
    """Item lengths as windows of a text of n words; longer items meet the whole text."""
    return sorted({min(m, n) for m in sizes})


def _regions(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], percent: int) -> DataFrame:
    """(d, a, n, w): document, first word, words in the document, words of each region."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), column_bytes(batch.column(1))
            rows = []
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                values, at = words.shingles(SHINGLE)
                hits = bits[_slots(values)]
                # A shingle weighs its words and one blank between each two, however wide the gaps of the text are.
                sums = np.concatenate(([0], np.cumsum(words.end - words.start)))
                weight = sums[at + SHINGLE] - sums[at] + SHINGLE - 1
                cut = np.searchsorted(at, words.first)
                for i in np.unique(words.text[at[hits > 0]]).tolist():
                    first, count = words.first[i], int(words.first[i + 1] - words.first[i])
                    hit, heavy = hits[cut[i]:cut[i + 1]], weight[cut[i]:cut[i + 1]]
                    inside = np.zeros(count + 1, dtype=np.int64)
                    for m in _sizes_for(count, sizes):
                        found = _covered(heavy, hit, m, percent)
                        np.add.at(inside, found, 1)
                        np.add.at(inside, found + m, -1)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(inside[:-1]) > 0, [0])).astype(np.int8)))
                    for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                        text = b" ".join(words.buffer[words.start[w]:words.end[w]].tobytes() for w in range(first + x, first + y))
                        rows.append((ids[a + i], x, count, text))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d", "a", "n", "w"])

    source = bounded_batches(docs).selectExpr("CAST(doc_id AS long) AS d", "CAST(text AS string) AS t").where("d IS NOT NULL AND t IS NOT NULL")
    return source.mapInArrow(run, "d long, a long, n long, w binary")


def _windows(regions: DataFrame, bitmap: np.ndarray, sizes: list[int], percent: int) -> DataFrame:
    """(d, a, p, s, m, f): region, place in it, window length, item length and fingerprint of every window."""
    shared = regions.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for batch in batches:
            parts = []
            for d, a, n, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = Words([text])
                values, at = words.shingles(SHINGLE)
                weight = words.end[at + SHINGLE - 1] - words.start[at]
                hits = bits[_slots(values)]
                for m in sizes:
                    size = min(m, n)
                    found = _covered(weight, hits, size, percent)
                    if len(found):
                        marks = fingerprints(words.hash, found, size)
                        parts.append(np.column_stack((np.full(len(found), d), np.full(len(found), a), found, np.full(len(found), size), np.full(len(found), m), marks)))
            rows = np.concatenate(parts) if parts else np.zeros((0, 6), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(6)], names=list("dapsmf"))

    return regions.mapInArrow(run, "d long, a long, p long, s long, m long, f long")


def _block_rows(near: bool) -> str:
    """SQL array of (block number, value) structs of the fingerprint f; with ``near`` also of the values that differ in one bit."""
    out = []
    for b, (start, width) in enumerate(BLOCKS):
        own = f"(shiftrightunsigned(f, {start}) & {(1 << width) - 1}L)"
        out += [f"struct({b} AS b, ({own} ^ {mask}L) AS v)" for mask in ([0] + [1 << i for i in range(width)] if near else [0])]
    return f"array({', '.join(out)})"


def benchmark_matches(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, position, n_words, similarity): for each document and item its best window, the first of equals."""
    table = materialize(_item_table(items), "items")
    sizes = sorted(r["m"] for r in table.select("m").distinct().collect())  # distinct lengths only
    bitmap = _bitmap(table)
    regions = materialize(_regions(docs, bitmap, sizes, percent), "regions")

    index = materialize(table.selectExpr("i", "m", "f AS g", f"inline({_block_rows(True)})"), "index")
    asked = _windows(regions, bitmap, sizes, percent).selectExpr("d", "a", "p", "s", "m", "f", f"inline({_block_rows(False)})")
    near = asked.join(index, ["m", "b", "v"]).where(f"bit_count(f ^ g) <= {RADIUS}").select("d", "a", "p", "s", "i").distinct()
    both = near.join(regions.select("d", "a", F.col("w").alias("rw")).distinct(), ["d", "a"]).join(table.select("i", F.col("w").alias("iw")).distinct(), "i")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, a, p, s, i, region, item in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                value = similarity(region.split(b" ")[p:p + s], item.split(b" "))
                if value * 100 >= percent:
                    rows.append((d, i, a + p, s, value))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "position", "n_words", "similarity"])

    checked = both.select("d", "a", "p", "s", "i", "rw", "iw").mapInArrow(check, "doc_id long, item_id long, position long, n_words long, similarity double")
    best = F.min_by(F.struct("position", "n_words", "similarity"), F.struct(-F.col("similarity"), "position")).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that hold a benchmark passage."""
    found = materialize(benchmark_matches(docs, items, percent).select(F.col("doc_id").alias("_d")).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").cast("long") == F.col("_d"), "left_anti")
