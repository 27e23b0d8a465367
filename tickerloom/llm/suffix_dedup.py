"""Bytes that repeat a 50-byte string of an earlier document, by a family of sparse suffix arrays.

Which suffixes
    Of the ``GRAM``-byte strings inside every ``MATCH``-byte window the one with the least hash
    is its head.  Consecutive windows with the same head form a run.  Equal windows
    have equal heads, so suffixes that start at heads (about one in sixteen) are
    enough to find every match, and a run whose string is equal to another one's
    shares all its windows.

Index family
    A batch's array holds suffixes in the order of their bytes, each as (x, y, run, h): the head's
    ``GRAM`` bytes as two longs of the same order, a hash of 64 bits of the run's string, and the text. All arrays
    are cut into slices of that order by the same bounds, taken from a sample once, so that each text is read
    once and a slice is sorted, scanned and merged by itself. Rows between slices travel as arrays, stored ones as whole files.
    A new batch is scanned together with the levels: a head that
    occurs in different texts is a long match to look at.  Then the batch becomes a level, and equal-sized levels merge,
    so n batches leave at most log2(n) + 1 levels. Bounds are whole suffixes, so a frequent head is spread over slices; what such heads
    have in common is settled over all slices at the end.

Exact removals
    Equal texts are one class, of which only the one with the smallest id is looked at.  A run that an earlier
    class has too goes as a whole.  An equal window of other runs with a shared head holds, beside the
    head, half of its other bytes on one side at least, so the first class of each string meets others by
    ``SIDE`` bytes to the left or right, and is dealt with its windows by these.  Of runs that so meet another string all windows are
    compared: a window goes if an earlier class has it.

Defined cases: rows without id are left out; null text is empty; rows that share an
id are one document, one of them is reported; texts under ``MATCH`` bytes are kept whole; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.text import ByteSums, bounded_batches, chunks, column_bytes, mix, positive
from tickerloom.scratch import discard, materialize, shuffles_dropped

MATCH = 50
GRAM = 16
#: Bytes that a window has from its head's start to its end, or from its start to its head's end, one of them at least.
SIDE = (MATCH + GRAM) // 2
#: Shares of the documents, in the order of their ids, that come as batches.
BATCHES = (1,) * 8
_PLACE = np.uint64((1 << 28) - 1)
_SIGN = np.uint64(1 << 63)
_MOST = np.iinfo(np.int64).max
#: Bytes of texts whose runs are found at once; their arrays fit a core's cache.
RUN_BYTES = 1 << 17
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: A task holds the suffixes, and then the runs to look at, of so many bytes of text at most.
SLICE_BYTES = 32 << 20
#: Rows given back to Spark at once.
_ROWS = 1 << 16
#: What becomes of a run that was found in several texts.
_OPEN, _WHOLE, _EDGE = range(3)
SUFFIX = "x long, y long, run long, h long"


def ordered_longs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``GRAM`` bytes at each place as two longs that sort as the bytes do."""
    eight = np.ndarray((max(len(raw) - 7, 0),), dtype=">u8", buffer=raw, strides=(1,))
    x, y = ((eight[at + k].astype(np.uint64) ^ _SIGN).view(np.int64) for k in (0, 8))
    return x, y


class Runs:
    """Runs of some texts: ``start``, ``number`` of windows, ``text``, place (``head``) and bytes (``x``, ``y``) of the head, and ``key`` per run."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        self.base = ends - lengths
        count = max(len(raw) - MATCH + 1, 0)
        # Places too near the end of their text start no window.
        inside = np.ones(count, dtype=bool)
        late = ends[:, None] - np.arange(1, MATCH)
        inside[late[(late >= self.base[:, None]) & (late < count)]] = False
        if not inside.any():
            self.start = self.number = self.text = self.head = self.x = self.y = self.key = np.zeros(0, dtype=np.int64)
            return
        self.sums = ByteSums(raw)
        # The upper bits of the hash, then the place: the minimum is the leftmost least gram.
        least = self.sums.all(GRAM)
        least &= ~_PLACE
        least |= np.arange(len(least), dtype=np.uint64)
        span, width = MATCH - GRAM + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:count], least[span - width:span - width + count])
        edge = np.ones(count, dtype=bool)
        np.logical_or(least[1:] != least[:-1], inside[1:] != inside[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        held = inside[at]
        self.start, self.number = at[held], np.diff(np.append(at, count))[held]
        self.text = np.searchsorted(ends, self.start, side="right")
        self.head = (least[self.start] & _PLACE).view(np.int64)
        self.x, self.y = ordered_longs(raw, self.head)
        self.key = positive(mix(self.sums.of(self.start, self.start + self.number + MATCH - 1), 3))

    def windows(self, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows that start at these places, or at all."""
        return positive(mix(self.sums.all(MATCH) if at is None else self.sums.of(at, at + MATCH), 4))

    def side(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``SIDE`` bytes that start at these places."""
        return positive(mix(self.sums.of(at, at + SIDE), 5))


def _source(docs: DataFrame) -> DataFrame:
    """(d, t): documents with an id, once each."""
    return bounded_batches(docs).selectExpr("CAST(doc_id AS long) AS d", "coalesce(CAST(text AS string), '') AS t").where("d IS NOT NULL")


def _first_of(rows: np.ndarray) -> np.ndarray:
    """Marks columns that differ from the one before."""
    new = np.zeros(rows.shape[1], dtype=bool)
    new[:1] = True
    for row in rows:
        new[1:] |= row[1:] != row[:-1]
    return new


def ordered(rows: np.ndarray, by: int = 4, kind: str | None = None) -> np.ndarray:
    """Columns of an array in the order of its first ``by`` rows; ``kind`` "stable" is faster for a few sorted pieces.

    Only groups of columns that the rows before leave equal and the next one has in a wrong order are sorted again, by half a long at a time.
    """
    rows = np.take(rows, np.argsort(rows[0], kind=kind), axis=1)
    new = _first_of(rows[:1])
    for row in rows[1:by]:
        for upper in (True, False):
            half = _halves(row, upper)
            wrong = np.flatnonzero(~new[1:] & (half[1:] < half[:-1])) + 1
            if len(wrong):
                group = np.cumsum(new)
                again = np.zeros(int(group[-1]) + 1, dtype=bool)
                again[group[wrong]] = True
                at = np.flatnonzero(again[group])
                part = np.take(rows, at, axis=1)
                rows[:, at] = np.take(part, np.argsort(group[at].astype(np.uint64) << np.uint64(32) | half[at]), axis=1)
                half = _halves(row, upper)
            new[1:] |= half[1:] != half[:-1]
    return rows


def _halves(row: np.ndarray, upper: bool) -> np.ndarray:
    """Of longs 32 bits, which sort as they do."""
    whole = row.view(np.uint64)
    return (whole ^ _SIGN) >> np.uint64(32) if upper else whole & np.uint64(0xFFFFFFFF)


def _record_batches(rows: np.ndarray, names: str) -> Iterator[pa.RecordBatch]:
    for a in range(0, rows.shape[1], _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[a:a + _ROWS]) for x in rows], names=names.split())


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """(x, y, run, h) as four rows of an array per batch of (h, t): the sparse suffixes of each text."""
    for batch in batches:
        hashes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        texts, found = column_bytes(batch.column(1).take(pa.array(first))), []
        for a, b in chunks(texts, RUN_BYTES):
            runs = Runs(texts[a:b])
            found.append(np.stack((runs.x, runs.y, runs.key, hashes[a:b][runs.text])))
        if found:
            yield np.concatenate(found, axis=1)


def _array(rows: DataFrame) -> DataFrame:
    """(x, y, run, h) of (h, t) rows: the sparse suffixes of each text, once per batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _suffixes(batches):
            found = ordered(found)
            yield from _record_batches(found[:, _first_of(found)], "x y run h")

    return rows.select("h", "t").mapInArrow(run, SUFFIX)


def in_order(array: DataFrame) -> DataFrame:
    """Suffixes in the order of their bytes, in slices of that order."""
    return array.repartitionByRange("x", "y", "run").sortWithinPartitions("x", "y", "run")


def order_bounds(array: DataFrame, slices: int) -> np.ndarray:
    """Suffixes, as columns in order, that cut ``array`` into at most so many slices of about equal size."""
    found = ordered(np.array([c.to_numpy() for c in array.toArrow().columns], dtype=np.int64).reshape(4, -1))
    found = found[:, _first_of(found)]
    return found[:, np.unique(np.arange(1, slices) * found.shape[1] // slices)] if found.shape[1] else found


def _packed(rows: np.ndarray) -> np.ndarray:
    """Columns of longs as strings that sort as they do."""
    return np.ascontiguousarray((rows.view(np.uint64) ^ _SIGN).astype(">u8").T).view("S32")[:, 0]


def slice_numbers(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per column of ``rows`` how many bounds are not after it."""
    out = np.searchsorted(bounds[0], rows[0], side="left")
    tied = np.flatnonzero(np.searchsorted(bounds[0], rows[0], side="right") > out)
    if len(tied):
        out[tied] = np.searchsorted(_packed(np.ascontiguousarray(bounds)), _packed(np.ascontiguousarray(rows[:, tied])), side="right")
    return out


def _dealt(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by number, the numbers that occur, and the edges of each in that order."""
    order = np.argsort(number.astype(np.uint16) if number.max(initial=0) < 1 << 16 else number, kind="stable")
    which, first = np.unique(number[order], return_index=True)
    return order, which, np.append(first, len(number))


def _by_slice(blobs: DataFrame, slices: int, work: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` for each slice ``s`` and all its rows; slice i is written as file i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                of.setdefault(row.pop("s"), []).append(row)
        for s in sorted(of):
            yield from work(s, of.pop(s))

    return blobs.repartitionById(slices, "s").mapInArrow(run, schema)


def sliced_array(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The suffixes of (h, t) rows, each once, in the order of their bytes and in the slices that ``bounds`` cut."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _suffixes(batches):
            order, which, edge = _dealt(slice_numbers(bounds, found))
            found = np.take(found, order, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([found[:, a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["s", "rows"])

    def put(_: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
        found = ordered(np.concatenate([np.frombuffer(x["rows"], dtype=np.int64).reshape(4, -1) for x in pieces], axis=1))
        yield from _record_batches(found[:, _first_of(found)], "x y run h")

    return _by_slice(rows.select("h", "t").mapInArrow(deal, "s int, rows binary"), bounds.shape[1] + 1, put, SUFFIX)


def _stored(rows: DataFrame, label: str) -> DataFrame:
    """:func:`materialize` for hashes, of which no dictionary is worth its time."""
    return materialize(rows, label, {"parquet.enable.dictionary": "false"})


def _slice_files(tables: list[DataFrame], slices: int) -> DataFrame:
    """(s, new, content): the files of stored tables of suffixes with the number of the slice; ``new`` for those of the first table."""
    out = None
    for i, table in enumerate(tables):
        files = table.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table._scratch_path)
        files = files.selectExpr(r"CAST(regexp_extract(path, '/part-([0-9]+)-[^/]*$', 1) AS INT) AS s" if slices > 1 else "0 AS s", f"{i == 0} AS new", "content")
        out = files if out is None else out.union(files)
    return out


def _file_rows(content: bytes) -> np.ndarray:
    table = pq.ParquetFile(pa.BufferReader(content)).read(["x", "y", "run", "h"], use_threads=False)
    return np.array([c.to_numpy() for c in table.columns], dtype=np.int64).reshape(4, -1)


def _slot(x: np.ndarray, bits: np.uint64) -> np.ndarray:
    return (x.view(np.uint64) * _SPREAD >> bits).view(np.int64)


class SuffixLevels:
    """The index family; levels are stored tables, largest first.

    Its tables are cut by the same ``bounds``, so a slice is scanned or merged by itself. Its files travel whole and are
    merged as arrays.
    """

    def __init__(self, bounds: np.ndarray | None = None) -> None:
        self.bounds = np.zeros((4, 0), dtype=np.int64) if bounds is None else bounds
        self.slices = self.bounds.shape[1] + 1
        self.levels: list[tuple[int, DataFrame]] = []

    def scan(self, array: DataFrame, again: bool = True) -> DataFrame:
        """Rows (x, y, run, h) of ``array`` and of all levels whose head several texts have.

        Without ``again`` rows of levels whose head several texts had before are left out, because the scan that first found them
        has returned them, and so are heads of levels that ``array`` does not have. Heads of bounds, which may go on in the next
        slice, are taken to be in several texts, and each scan returns the rows of ``array`` only.
        """
        bounds = self.bounds

        def work(s: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
            mine = [_file_rows(x["content"]) for x in pieces if x["new"]]
            heads = np.sort(np.concatenate([x[0] for x in mine])) if mine else np.zeros(0, dtype=np.int64)
            # A table with a bit of each head's hash rules most rows of the levels out.
            bits = np.uint64(64 - 4 - len(heads).bit_length())
            slots = np.zeros(16 << len(heads).bit_length(), dtype=bool)
            slots[_slot(heads, bits)] = True
            parts = [np.concatenate((x, np.ones_like(x[:1]))) for x in mine]
            for x in (x["content"] for x in pieces if not x["new"]):
                rows = _file_rows(x)
                if not again:
                    at = np.flatnonzero(slots[_slot(rows[0], bits)])
                    rows = np.take(rows, at[among(rows[0, at], heads)], axis=1)
                    if rows.shape[1]:
                        # Of rows with one head the least and the greatest text tell that it was in several.
                        first, h = np.flatnonzero(_first_of(rows[:2])), rows[3]
                        size = np.diff(np.append(first, len(h)))
                        rows = rows[:, (h == np.repeat(np.minimum.reduceat(h, first), size)) | (h == np.repeat(np.maximum.reduceat(h, first), size))]
                parts.append(np.concatenate((rows, np.zeros_like(rows[:1]))))
            rows = ordered(np.concatenate(parts, axis=1), by=2, kind="stable")
            if not rows.shape[1]:
                return
            first = np.flatnonzero(_first_of(rows[:2]))
            size, h, new = np.diff(np.append(first, rows.shape[1])), rows[3], rows[4] > 0
            kept = np.minimum.reduceat(h, first) < np.maximum.reduceat(h, first)
            kept = np.repeat(kept, size)
            if not again:
                known = np.minimum.reduceat(np.where(new, _MOST, h), first) < np.maximum.reduceat(np.where(new, -_MOST - 1, h), first)
                kept &= new | ~np.repeat(known, size)
            edge = _at_edge(rows, bounds, s)
            kept[edge] = again | new[edge]
            yield from _record_batches(rows[:4, kept], "x y run h")

        stored = array if hasattr(array, "_scratch_path") else _stored(array, "array")
        return _by_slice(_slice_files([stored, *(level for _, level in self.levels)], self.slices), self.slices, work, SUFFIX)

    def add(self, array: DataFrame, size: int = 1) -> None:
        """Make a stored ``array`` a level and merge levels of equal size, all that come together in one merge."""

        def work(_: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
            yield from _record_batches(ordered(np.concatenate([_file_rows(x["content"]) for x in pieces], axis=1), by=3, kind="stable"), "x y run h")

        merged = [array]
        while self.levels and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            size *= 2
        if len(merged) > 1:
            array = _stored(_by_slice(_slice_files(merged, self.slices), self.slices, work, SUFFIX), "level")
            for table in merged:
                discard(table)
        self.levels.append((size, array))

    def drop(self) -> None:
        """Delete the stored levels."""
        for _, level in self.levels:
            discard(level)
        self.levels = []


def _at_edge(rows: np.ndarray, bounds: np.ndarray, s: int) -> np.ndarray:
    """Marks the rows of slice ``s`` whose head another slice may have too, because a bound has it."""
    edge = np.zeros(rows.shape[1], dtype=bool)
    for x, y in bounds[:2, max(s - 1, 0):s + 1].T:
        edge |= (rows[0] == x) & (rows[1] == y)
    return edge


def _leads(scanned: list[DataFrame], bounds: np.ndarray) -> DataFrame:
    """(d, k, kind, x, y) of all matches: runs k of documents d that go as a whole, and of heads with runs of different strings the first of each string.

    Runs whose head two slices may have come as they are, with their head.
    """

    def work(s: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = ordered(np.concatenate([_file_rows(x["content"]) for x in pieces], axis=1), kind="stable")
        rows = rows[:, _first_of(rows)]
        if not rows.shape[1]:
            return
        new_head, new_run = _first_of(rows[:2]), _first_of(rows[:3])
        head, run = np.cumsum(new_head) - 1, np.cumsum(new_run) - 1
        several = np.bincount(head[new_run]) > 1
        edge = _at_edge(rows, bounds, s)
        kind = np.where(edge, _EDGE, np.where(rows[3] > rows[3][new_run][run], _WHOLE, _OPEN))
        kept = several[head] | (kind != _OPEN)
        x, y = (np.where(edge, r, 0) for r in rows[:2])
        yield from _record_batches(np.stack((rows[3], rows[2], kind, x, y))[:, kept], "d k kind x y")

    slices = bounds.shape[1] + 1
    return _by_slice(_slice_files(scanned, slices), slices, work, "d long, k long, kind long, x long, y long")


def _across_slices(rows: DataFrame) -> DataFrame:
    """(d, k, kind) of what :func:`_leads` left as it is."""
    lead = rows.groupBy("x", "y", "k").agg(F.min("d").alias("first"))
    # One row per head of a bound.
    heads = lead.groupBy("x", "y").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    rows = rows.drop("kind").join(lead.join(F.broadcast(heads), ["x", "y"]), ["x", "y", "k"])
    return rows.where("d > first OR lo < hi").selectExpr("d", "k", f"IF(d > first, {_WHOLE}L, {_OPEN}L) AS kind")


def among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``chosen``."""
    if not len(chosen):
        return np.zeros(len(values), dtype=bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def _lists(column: pa.ListArray) -> Callable[[int], np.ndarray]:
    """The sorted values of a row of a column of lists of longs."""
    edge, values = column.offsets.to_numpy(), column.values.to_numpy()
    return lambda i: np.sort(values[edge[i]:edge[i + 1]])


def _chosen(runs: Runs, keys: Callable[[int], np.ndarray], a: int, b: int) -> np.ndarray:
    """Marks the runs of texts a to b whose key is in their text's list."""
    cut = np.searchsorted(runs.text, np.arange(b - a + 1))
    return np.concatenate([among(runs.key[cut[i]:cut[i + 1]], keys(a + i)) for i in range(b - a)])


def _of_documents(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, t, k): texts with the ``wanted`` (d, k) of each as a list."""
    return texts.join(wanted.groupBy("d").agg(F.collect_list("k").alias("k")), "d").select("d", "t", "k")


def _beside(rows: DataFrame, slices: int) -> DataFrame:
    """The runs k of (d, t, k) by the ``SIDE`` bytes that end or start with their head, dealt by the hash v of these: per run v, k, d and the number n and hashes w of windows.

    A window is listed with the left bytes if it holds them, else with the right ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = batch.column(0).to_numpy(), column_bytes(batch.column(1)), _lists(batch.column(2))
            found: list[list[np.ndarray]] = []
            for a, b in chunks(texts, RUN_BYTES):
                runs = Runs(texts[a:b])
                at = np.flatnonzero(_chosen(runs, keys, a, b))
                if len(at):
                    start, number, head = runs.start[at], runs.number[at], runs.head[at]
                    left = np.clip(head - (SIDE - GRAM) - start + 1, 0, number)
                    for first, many, side in ((start, left, head - (SIDE - GRAM)), (start + left, number - left, head)):
                        held = many > 0
                        first, many = first[held], many[held]
                        place = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
                        found.append([runs.side(side[held]), runs.key[at][held], ids[a:b][runs.text[at]][held], many, runs.windows(place)])
                if b == len(texts) or sum(len(x[0]) for x in found) > _ROWS:
                    yield from dealt(found)
                    found = []

    def dealt(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        v, k, d, n, w = (np.concatenate(x) for x in zip(*found, strict=True))
        order, which, edge = _dealt(v % slices)
        order_w, _, edge_w = _dealt(np.repeat(v % slices, n))
        columns = [(x[order], edge) for x in (v, k, d, n)] + [(w[order_w], edge_w)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), *(pa.array([x[p:q].tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x, cut in columns)], names=["s", "v", "k", "d", "n", "w"])

    return rows.mapInArrow(run, "s int, v binary, k binary, d binary, n binary, w binary")


def _met(pieces: list[dict]) -> tuple[np.ndarray, ...]:
    """(k, d, n, w) of what :func:`_beside` gave of a slice, without bytes that only one string of a run has beside its head."""
    v, k, d, n, w = (np.concatenate([np.frombuffer(x[c], dtype=np.int64) for x in pieces]) for c in "vkdnw")
    order = np.argsort(v)
    first = np.flatnonzero(_first_of(v[order][None]))
    several = np.minimum.reduceat(k[order], first) < np.maximum.reduceat(k[order], first)
    met = np.zeros(len(v), dtype=bool)
    met[order] = np.repeat(several, np.diff(np.append(first, len(v))))
    return k[met], d[met], n[met], w[np.repeat(met, n)]


def _slices(spark: SparkSession, size: int = 0) -> int:
    """As many as shuffle partitions, and so many that none has more than its share of ``size`` bytes of text."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES))


def meeting(texts: DataFrame, open_runs: DataFrame) -> DataFrame:
    """Those of ``open_runs`` (d, k) that have ``SIDE`` bytes around their head in common with a run of another string."""

    def work(_: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
        k, d, _, _ = _met(pieces)
        yield from _record_batches(np.stack((d, k)), "d k")

    slices = _slices(texts.sparkSession)
    return _by_slice(_beside(_of_documents(texts, open_runs), slices), slices, work, "d long, k long").distinct()


def later_windows(texts: DataFrame, open_runs: DataFrame, slices: int) -> DataFrame:
    """(d, k): the windows k of ``open_runs`` (d, k) that a document before d has in one of them. Only those of runs that meet others are compared."""

    def work(_: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
        _, d, n, w = _met(pieces)
        if len(w):
            order = np.argsort(w)
            w, d = w[order], np.repeat(d, n)[order]
            first = np.flatnonzero(_first_of(w[None]))
            later = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(w))))
            yield from _record_batches(np.stack((d[later], w[later])), "d k")

    return _by_slice(_beside(_of_documents(texts, open_runs), slices), slices, work, "d long, k long")


def removed_marks(runs: Runs, lengths: np.ndarray, whole: np.ndarray, windows: Callable[[int], np.ndarray]) -> np.ndarray:
    """Which bytes of the texts, one after the other, the runs marked ``whole`` and the windows of each text cover."""
    total = int(lengths.sum())
    start, end = [runs.start[whole]], [runs.start[whole] + runs.number[whole] + MATCH - 1]
    each = [windows(i) for i in range(len(lengths))]
    if any(len(x) for x in each):
        # A table of 16 bits of the hash rules most places out.
        table = np.zeros(1 << 16, dtype=bool)
        table[np.concatenate(each) & 0xFFFF] = True
        hashes = runs.windows()
        may = np.flatnonzero(table[hashes & 0xFFFF])
        cut = np.searchsorted(may, np.stack((runs.base, runs.base + lengths - MATCH + 1)))
        for i, chosen in enumerate(each):
            if len(chosen):
                at = may[cut[0, i]:cut[1, i]]
                at = at[among(hashes[at], chosen)]
                start.append(at)
                end.append(at + MATCH)
    cover = np.bincount(np.concatenate(start), minlength=total + 1) - np.bincount(np.concatenate(end), minlength=total + 1)
    return np.cumsum(cover[:-1]) > 0


def _digest(rows: DataFrame) -> DataFrame:
    """Result columns for (d, t, runs, windows)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = column_bytes(batch.column(1)), []
            whole, windows = _lists(batch.column(2)), _lists(batch.column(3))
            for a, b in chunks(texts, RUN_BYTES):
                runs, lengths = Runs(texts[a:b]), np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a)
                raw = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
                marks = removed_marks(runs, lengths, _chosen(runs, whole, a, b), lambda i, a=a: windows(a + i))
                for base, length in zip(runs.base.tolist(), lengths.tolist(), strict=True):
                    gone = marks[base:base + length]
                    spans = int(np.count_nonzero(gone[1:] > gone[:-1])) + int(gone[:1].sum())
                    out.append((length, int(np.count_nonzero(gone)), spans, hashlib.sha256(raw[base:base + length][~gone]).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, schema)


def _looked_at(texts: DataFrame, batches: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """Of (d, t) the ids (d, h, g, n) with the first id c of each class of equal texts, and result columns of texts that lose bytes, both stored."""
    spark = texts.sparkSession
    hashed = texts.selectExpr("d", "xxhash64(t) AS h", "xxhash64(7, t) AS g", "octet_length(t) AS n")
    hashes = materialize(hashed.groupBy("d").agg(F.min(F.struct("h", "g", "n")).alias("x")).select("d", "x.*"), "hashes")
    ids = materialize(hashes.join(hashes.groupBy("h", "g", "n").agg(F.min("d").alias("c")), ["h", "g", "n"]), "ids")
    discard(hashes)
    firsts = ids.where(f"d = c AND n >= {MATCH}").select("d", "h")

    # Batches in the order of ids.
    ends = [sum(batches[: i + 1]) / sum(batches) for i in range(len(batches) - 1)]
    cuts, count, size = ids.agg(F.percentile_approx("d", ends or [1.0], 10_000), F.count("d"), F.expr("coalesce(sum(CAST(n AS long)), 0L)")).first()
    slices = _slices(spark, size)
    every = max(1, count // (16 * slices))
    sample = _array(texts.where(f"pmod(xxhash64(d), {every}) = 0").selectExpr("d AS h", "t")).where(f"pmod(run, {min(64, max(1, count // every // 16))}) = 0")
    bounds = order_bounds(sample, slices)
    family, scanned = SuffixLevels(bounds), []
    limits = [None, *sorted(set(cuts or []))[: len(ends)], None]
    for low, high in zip(limits[:-1], limits[1:], strict=True):
        condition = " AND ".join(["true"] + ([f"d > {low}"] if low is not None else []) + ([f"d <= {high}"] if high is not None else []))
        mine = texts.where(condition).withColumn("h", F.expr("xxhash64(t)")).join(firsts.where(condition), ["d", "h"], "left_semi")
        array = _stored(sliced_array(mine.selectExpr("d AS h", "t"), bounds), "array")
        scanned.append(_stored(family.scan(array, again=False), "matches"))
        if high is None:
            # The last batch is no level: nothing comes after it.
            discard(array)
        else:
            family.add(array)
    family.drop()
    known = _stored(_leads(scanned, bounds), "runs")
    for part in scanned:
        discard(part)
    settled = known.where(f"kind <> {_EDGE}").select("d", "k", "kind").union(_across_slices(known.where(f"kind = {_EDGE}")))
    single = _stored(later_windows(texts, settled.where(f"kind = {_OPEN}").select("d", "k"), slices), "windows")
    found = settled.where(f"kind = {_WHOLE}").groupBy("d").agg(F.collect_list("k").alias("runs")).join(single.groupBy("d").agg(F.collect_list("k").alias("windows")), "d", "full")
    found = texts.join(found, "d").selectExpr("d", "t", "coalesce(runs, CAST(array() AS array<long>)) AS runs", "coalesce(windows, CAST(array() AS array<long>)) AS windows")
    touched = materialize(_digest(found), "touched")
    discard(known)
    discard(single)
    return ids, touched


def repeated_bytes(docs: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document."""
    texts = _source(docs)
    with shuffles_dropped(docs.sparkSession):
        ids, touched = _looked_at(texts, batches)
    # Copies of a whole text lose everything if it is long enough; untouched texts keep everything.
    copied = ids.where("d <> c").selectExpr(
        "d AS doc_id", "CAST(n AS long) AS n_bytes", f"IF(n >= {MATCH}, n, 0) AS n_removed", f"IF(n >= {MATCH}, 1, 0) AS n_spans", f"IF(n >= {MATCH}, sha2('', 256), NULL) AS kept_sha256")
    plain = texts.selectExpr("d AS doc_id", "CAST(octet_length(t) AS long) AS n_bytes", "0L AS n_removed", "0L AS n_spans", "sha2(t, 256) AS kept_sha256")
    plain = plain.join(ids.where(f"d = c OR n < {MATCH}").selectExpr("d AS doc_id"), "doc_id", "left_semi").join(touched.select("doc_id"), "doc_id", "left_anti")
    mine = touched.join(ids.where("d = c").select(F.col("d").alias("doc_id")), "doc_id", "left_semi")
    return mine.union(copied.where(f"n_bytes >= {MATCH}").selectExpr("doc_id", "n_bytes", "CAST(n_removed AS long)", "CAST(n_spans AS long)", "kept_sha256")).union(plain).dropDuplicates(["doc_id"])
