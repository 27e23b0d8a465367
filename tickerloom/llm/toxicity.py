"""Toxic passages by maximum-scoring segment search over token log-odds.

Fit (on labelled rows of the training folds)
    Every word gets the log-odds of toxic against clean documents that hold it.
    The counts have Dirichlet priors in a chain: all documents, the word's first
    four bytes, its first five bytes, the word.  Unseen words so take the odds
    of their stem.  Counts live in hashed buckets of fixed number.
    At most ``LABELLED`` labelled rows are used (those with the smallest hash of
    their id); rows with equal texts count once.

Search
    Word scores less ``DRIFT`` are negative on ordinary text.  One linear scan
    per document (Ruzzo and Tompa) gives all its maximal-scoring segments; it
    only visits words with positive scores.

Calibration
    The best segment of n ordinary words exceeds s with probability
    1 - exp(-K n exp(-lambda s)) (Karlin and Altschul).  lambda solves
    sum p(s) exp(lambda s) = 1 over the word scores of clean training documents
    and K follows from the mean of their best segments.  A document's evidence is
    the sum of the positive excesses lambda s - ln(K n) of its segments, without
    any its best excess, and a two-parameter logistic fit over the training rows turns it into a score.

Defined cases: rows without id are left out; null, empty or blank text has no
segment and gets the score of no evidence; rows that share an id are scored
each on its own; without usable labels every score is 0; an empty table gives
no rows; labels, language, source and id never enter a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.text import bounded_batches, column_bytes

LABELLED = 50_000
BUCKETS = 1 << 18
STEMS = (4, 5)
STEM_PRIOR = 30.0
WORD_PRIOR = 15.0
DRIFT = 1.2
SCORE_LIMIT = 6.0
SIGNIFICANT = 0.01
_CACHE = 150_000
#: Bytes that end a word: ASCII white space, control and punctuation characters.
_SEPARATE = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_SEPARATE).split()


def features_of(word: bytes) -> tuple[int, ...]:
    """Buckets of the word's stems, then of the word itself."""
    return (*(zlib.crc32(word[:n], n) % BUCKETS + i * BUCKETS for i, n in enumerate(STEMS)), zlib.crc32(word) % BUCKETS + len(STEMS) * BUCKETS)


class WordScores(dict):
    """Score per word, computed when first asked for; emptied when it grows too large."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, base: float):
        super().__init__()
        self.toxic, self.clean, self.base = toxic, clean, base

    def __missing__(self, word: bytes) -> float:
        share = self.base
        features = features_of(word)
        for at in features:
            prior = STEM_PRIOR if at < len(STEMS) * BUCKETS else WORD_PRIOR
            t, c = float(self.toxic[at]), float(self.clean[at])
            share = (t + prior * share) / (t + c + prior)
        score = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
        score = min(max(score, -SCORE_LIMIT), SCORE_LIMIT) - DRIFT
        if len(self) >= _CACHE:
            self.clear()
        self[word] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) by the scan of Ruzzo and Tompa."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # first, last, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        first, before, after = i, total[i], total[i + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                found.append([first, i, before, after])
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
            j -= 1
    return [(a, b, float(y - x)) for a, b, x, y in found]


@dataclass
class Model:
    toxic: np.ndarray
    clean: np.ndarray
    base: float
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = -4.0

    def excess(self, score: float, words: int) -> float:
        return self.rate * score - self.log_k - math.log(max(words, 1))

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> float:
        excesses = [self.excess(s, words) for _, _, s in found] or [self.excess(0.0, words)]
        return sum(x for x in excesses if x > 0) or max(excesses)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(max(self.slope * evidence + self.intercept, -60.0), 60.0)))


def _scored(texts: list[bytes], scores: WordScores) -> Iterator[tuple[np.ndarray, list]]:
    for text in texts:
        words = words_of(text)
        own = np.fromiter(map(scores.__getitem__, words), dtype=np.float64, count=len(words))
        yield own, segments(own)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: str, most: int = LABELLED) -> DataFrame:
    """(t, y) of at most ``most`` labelled documents of the training folds, equal texts once."""
    texts = docs.selectExpr("CAST(doc_id AS long) AS d", "CAST(text AS string) AS t")
    marked = labels.selectExpr("CAST(doc_id AS long) AS d", f"CAST({label} AS int) AS y").where("d IS NOT NULL AND y IS NOT NULL").where(fold)
    sample = F.broadcast(marked.orderBy(F.xxhash64("d"), "d", "y").limit(most))
    once = texts.where("t IS NOT NULL").join(sample, "d").groupBy(F.xxhash64("t").alias("h")).agg(F.min_by("y", F.struct("d", "y")).alias("y"), F.min("d").alias("d"))
    return texts.join(F.broadcast(once.select("d", "y")), "d").select("t", "y")


def _count(rows: DataFrame) -> DataFrame:
    size = (len(STEMS) + 1) * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), dtype=np.int64)
        totals = [0, 0]
        for batch in batches:
            for text, y in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                present = {at for word in set(words_of(text)) for at in features_of(word)}
                counts[int(y > 0)][np.fromiter(present, dtype=np.int64, count=len(present))] += 1
                totals[y > 0] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(counts[1, at], totals[1])), pa.array(np.append(counts[0, at], totals[0]))], names=["b", "t", "c"])

    return rows.mapInArrow(run, "b long, t long, c long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _root(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with sum weights exp(lambda values) = sum weights."""
    if not weights[values > 0].any() or (values * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    moment = lambda x: float((weights * (np.exp(np.minimum(x * values, 600.0)) - 1)).sum())
    while moment(high) < 0:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with a small ridge, by Newton steps on a scaled input."""
    scale = max(float(x.std()), 1e-9)
    design = np.column_stack((x / scale, np.ones(len(x))))
    w = np.array([0.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), gradient)
        w -= np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fold: str, label: str = "toxic", most: int = LABELLED) -> Model | None:
    """The model of the rows that ``fold`` (an SQL condition on the id ``d``) lets in; None without both labels."""
    rows = labelled_texts(bounded_batches(docs), labels, label, fold, most)
    counts = _count(rows).toArrow()  # at most three times BUCKETS rows and one
    at, t, c = (counts.column(i).to_numpy() for i in range(3))
    size = (len(STEMS) + 1) * BUCKETS
    toxic, clean = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    toxic[at[at >= 0]], clean[at[at >= 0]] = t[at >= 0], c[at >= 0]
    totals = (int(t[at < 0].sum()), int(c[at < 0].sum()))
    if not all(totals):
        return None
    model = Model(toxic, clean, totals[0] / sum(totals))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    step = 0.05
    bins = int(2 * (SCORE_LIMIT + DRIFT) / step) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model.toxic, model.clean, model.base)
        histogram = np.zeros(bins, dtype=np.int64)
        for batch in batches:
            out = []
            labels = batch.column(1).to_pylist()
            for y, (own, found) in zip(labels, _scored(column_bytes(batch.column(0)), scores), strict=True):
                if not y:
                    histogram += np.bincount(np.rint((own + SCORE_LIMIT + DRIFT) / step).astype(np.int64), minlength=bins)
                out.append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array([len(words_of(x)) for x in column_bytes(batch.column(0))], pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["y", "n", "s"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([histogram.astype(float).tolist()], pa.list_(pa.float64()))], names=["y", "n", "s"])

    # One row per labelled document of the bounded sample and one histogram per task.
    found = rows.mapInArrow(run, "y int, n long, s array<double>").toArrow().to_pylist()
    histogram = np.sum([r["s"] for r in found if r["y"] < 0], axis=0)
    found = [r for r in found if r["y"] >= 0]
    model.rate = _root(np.arange(bins) * step - SCORE_LIMIT - DRIFT, histogram)
    best = [model.rate * max(r["s"]) - math.log(r["n"]) for r in found if not r["y"] and r["s"]]
    model.log_k = float(np.mean(best)) - 0.5772 if best else 0.0
    evidence = np.array([model.evidence([(0, 0, s) for s in r["s"]], r["n"]) for r in found])
    model.slope, model.intercept = _logistic(evidence, np.array([float(r["y"] > 0) for r in found]))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, passages): passages are the significant segments with word positions and p-values."""
    schema = "doc_id long, score double, passages array<struct<first: long, last: long, score: double, p_value: double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model.toxic, model.clean, model.base) if model else None
        for batch in batches:
            values, passages = [], []
            for own, found in _scored(column_bytes(batch.column(1)), scores) if model else (((), ()) for _ in range(len(batch))):
                kept = []
                for first, last, s in found:
                    p = -math.expm1(-math.exp(min(-model.excess(s, len(own)), 50.0)))
                    if p <= SIGNIFICANT:
                        kept.append({"first": first, "last": last, "score": s, "p_value": p})
                values.append(model.probability(model.evidence(found, len(own))) if model else 0.0)
                passages.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64()), pa.array(passages, pa.list_(passage))], names=["doc_id", "score", "passages"])

    return bounded_batches(docs).selectExpr("CAST(doc_id AS long) AS d", "CAST(text AS string) AS t").where("d IS NOT NULL").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches ``least``; rows without id are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model.toxic, model.clean, model.base) if model else None
        for batch in batches:
            if model:
                keep = [model.probability(model.evidence(found, len(own))) < least for own, found in _scored(column_bytes(batch.column(at)), scores)]
                batch = batch.filter(pa.array(keep, pa.bool_()))
            yield batch

    return bounded_batches(docs).mapInArrow(run, docs.schema)
