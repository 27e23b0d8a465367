"""Word, shingle and window hashing of many texts at once, for use inside Arrow batches.

Texts are handled as UTF-8 bytes.  All arithmetic is modulo 2^64 on numpy
arrays; a hash of a word is a polynomial over random byte values, so equal
bytes give equal hashes on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 19
#: Texts per Arrow batch; a batch and its copies as Python objects stay in memory together.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 40, 1 << 62)) * 2 + 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with Arrow batches of its session limited to ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(docs.sparkSession.conf.get(name))
    if not 0 < most <= BATCH_ROWS:
        docs.sparkSession.conf.set(name, BATCH_ROWS)
    return docs


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, with Arrow batches of its session limited to ``BATCH_BYTES``; for rows of very different sizes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows.sparkSession.conf.set(name, min(int(rows.sparkSession.conf.get(name).rstrip("b")), BATCH_BYTES))
    return rows


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step
        done += take
    return out


#: Of the base and of its inverse, for texts up to a chunk.
_POWERS: dict[bool, np.ndarray] = {}


def _powers_for(n: int, back: bool = False) -> np.ndarray:
    """At least ``n`` powers of the base, or of its inverse; made once for all chunks."""
    base = pow(_BASE, -1, 1 << 64) if back else _BASE
    if n > CHUNK_BYTES + 1:
        return powers(n, base)[:n]
    if back not in _POWERS:
        _POWERS[back] = powers(CHUNK_BYTES + 1, base)
    return _POWERS[back][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positive(values: np.ndarray) -> np.ndarray:
    """The upper 63 bits, as Spark longs."""
    return (values >> np.uint64(1)).view(np.int64)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words (runs without ASCII white space) of some texts.

    ``hash`` has one entry per word, ``first[i]:first[i + 1]`` are the words of
    text ``i``; ``start`` and ``end`` are byte positions in ``buffer``, where
    text ``i`` begins at ``base[i]``.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, dtype=np.uint8)
        self.buffer = _LOWER[raw] if lower else raw
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.first = np.searchsorted(self.start, np.concatenate((self.base, [len(raw)])))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if len(self.start):
            size = self.end - self.start
            inside = np.flatnonzero(~space)
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            place = np.arange(len(inside)) - np.repeat(begin, size)
            values = _BYTE[self.buffer[inside]] * powers(int(size.max()))[place]
            self.hash = mix(np.add.reduceat(values, begin))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles, with the number of the first word of each."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        out = self.hash[:count].copy()
        for j in range(1, n):
            out = out * np.uint64(_BASE) + self.hash[j:j + count]
        at = np.flatnonzero(self.text[:count] == self.text[n - 1:])
        return mix(out[at], n), at

    def whole(self, i: int) -> int:
        """Hash of all words of text ``i`` as one shingle."""
        value = 0
        for h in self.hash[self.first[i]:self.first[i + 1]].tolist():
            value = (value * _BASE + h) & _MASK
        return int(mix(np.array([value], dtype=np.uint64), int(self.first[i + 1] - self.first[i]))[0])


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles.

    A text with fewer than ``n`` words has its whole word sequence as its only
    shingle, one without words has none.
    """
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        values, at = words.shingles(n)
        cut = np.searchsorted(at, words.first)
        for i in range(b - a):
            if words.first[i + 1] - words.first[i] >= n:
                yield np.unique(values[cut[i]:cut[i + 1]])
            elif words.first[i + 1] > words.first[i]:
                yield np.array([words.whole(i)], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


#: Sentences of more words are cut inside; runs without a content-chosen cut are cut after so many words.
LONG_WORDS = 40
#: Hash cuts in long sentences are at least this many words apart, 17 on average.
CUT_REACH = 8


def _local_minima(values: np.ndarray, place: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """Marks values below all others of their group within ``reach`` places; the first of equals counts."""
    out = np.ones(len(values), dtype=bool)
    for step in range(1, min(reach, len(values) - 1) + 1):
        near = (place[step:] - place[:-step] <= reach) & (group[step:] == group[:-step])
        out[step:] &= ~near | (values[step:] < values[:-step])
        out[:-step] &= ~near | (values[:-step] <= values[step:])
    return out


def _capped(place: np.ndarray, cut: np.ndarray, start: int, least: int) -> list[int]:
    """Places to cut besides ``cut``, so that no piece from ``start`` goes on for LONG_WORDS words past which a place follows."""
    more = []
    for p, chosen in zip(place.tolist(), cut.tolist(), strict=True):
        if chosen:
            start = p + 1
        elif p + 1 - start >= max(LONG_WORDS, least):
            more.append(p)
            start = p + 1
    return more


def paragraphs(words: Words, least: int) -> np.ndarray:
    """Numbers of the last words of content-defined paragraphs.

    A sentence ends with ``.``, ``!`` or ``?``, before a line break or with its
    text.  A paragraph ends with each sentence of at least ``least`` words.  A run
    of shorter ones ends paragraphs where a sentence's hash is the least within
    ``least`` words, and with its last sentence, if ``least`` words stand before; what is left
    joins the sentence that follows.  Sentences of over LONG_WORDS words are also cut
    where a word's hash is the least within CUT_REACH words, from their first word on.
    Where hashes repeat and give no cut, one follows after LONG_WORDS words.
    Text around a repeated passage can thus change its first and last paragraphs only.
    """
    n = len(words.hash)
    if not n:
        return np.zeros(0, dtype=np.int64)
    lines = np.cumsum(words.buffer == 10)
    over = np.append(words.start[1:], len(words.buffer) - 1)
    final = np.append(words.text[1:] != words.text[:-1], True)
    stop = np.isin(words.buffer[words.end - 1], np.frombuffer(b".!?", dtype=np.uint8)) | (lines[over - 1] > lines[words.end - 1]) | final
    last = np.flatnonzero(stop)
    begin = np.concatenate(([0], last[:-1] + 1))
    size = last + 1 - begin
    cut = final.copy()
    cut[last[size >= least]] = True

    # Runs of short sentences; a run ends with its text.
    short = size < least
    if short.any():
        fresh = short & ~np.concatenate(([False], short[:-1] & (words.text[last[1:]] == words.text[last[:-1]])))
        run = np.cumsum(fresh)[short]
        ends, firsts = last[short], begin[short]
        run_start = firsts[np.flatnonzero(fresh[short])]
        run_last = np.append(ends[np.flatnonzero(fresh[short])[1:] - 1], ends[-1])
        if (run_last - run_start + 1 >= least).any():
            place = np.arange(n) - np.repeat(begin, size)
            value = np.add.reduceat(mix(words.hash, 7) * powers(int(size.max()))[place], begin)[short]
            room = ends + 1 - run_start[run - 1] >= least
            chosen = _local_minima(mix(value, 8), ends, run, least - 1) & room
            cut[ends[chosen]] = True
            bounds = np.searchsorted(run, np.arange(1, len(run_start) + 2))
            for r in np.flatnonzero(run_last - run_start + 1 >= least).tolist():
                x, y = bounds[r], bounds[r + 1]
                if run_last[r] - run_start[r] >= LONG_WORDS:
                    cut[_capped(ends[x:y], chosen[x:y], int(run_start[r]), least)] = True
                before = np.flatnonzero(cut[run_start[r]:run_last[r]])
                since = run_last[r] - run_start[r] - (int(before[-1]) if len(before) else -1)
                if since >= least:
                    cut[run_last[r]] = True

    # Long sentences.
    long = np.flatnonzero(size > LONG_WORDS)
    if len(long):
        inside = np.concatenate([np.arange(begin[s], last[s] + 1) for s in long.tolist()])
        owner = np.repeat(np.arange(len(long)), size[long])
        chosen = _local_minima(words.hash[inside], inside, owner, CUT_REACH)
        chosen &= (inside + 1 - begin[long][owner] >= least) & (last[long][owner] - inside >= least)
        cut[inside[chosen]] = True
        edge = np.concatenate(([0], np.cumsum(size[long])))
        for k, s in enumerate(long.tolist()):
            piece = chosen[edge[k]:edge[k + 1]]
            marks = np.concatenate(([-1], np.flatnonzero(piece), [len(piece) - 1]))
            if (np.diff(marks) > LONG_WORDS + least).any():
                room = slice(edge[k], edge[k + 1] - least)
                cut[_capped(inside[room], chosen[room], int(begin[s]), least)] = True
    return np.flatnonzero(cut)


class ByteSums:
    """Hashes of any strings of some bytes, from one running sum: equal strings have equal hashes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        self.back = _powers_for(len(raw) + 1, back=True)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * _powers_for(len(raw)), out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of every string of ``size`` bytes, before mixing: only the upper bits depend on all of it."""
        out = self.sums[size:] - self.sums[:max(len(self.sums) - size, 0)]
        out *= self.back[:len(out)]
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from each ``start`` to before its ``end``, before mixing."""
        return (self.sums[end] - self.sums[start]) * self.back[start]
