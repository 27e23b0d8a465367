"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good in the training folds, the
unlabelled set is every document of those folds, and the class prior is the
share of good rows among the labelled ones.  For the logistic loss l and a
linear score g the unbiased risk is

    R(g) = -prior * E_P[g] + E_U[l(-g)],

which is convex; its part E_U[l(-g)] - prior * E_P[l(-g)] estimates the risk on
unseen bad documents and must not fall below zero by more than two of its own
standard errors.  Newton steps minimise R with a small ridge over all rows (sums
are taken in parallel, one small matrix per task comes back); a step that would
break that bound is halved until it does not.  Last, the intercept is moved so
that the mean probability of the unlabelled rows is the prior, as it is at the
minimum of R.

Features describe a text's surface: shares of character classes, word lengths,
repetition of words and lines, and their squares, each standardised.  Nothing
else enters a score.

Defined cases: rows without id are left out; null or empty text has all-zero
features and gets their score; rows that share an id are scored each on its own;
without any positive or unlabelled row every score is 0.5; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.text import Words, bounded_batches, chunks, column_bytes
from tickerloom.scratch import materialize

RIDGE = 2e-3
STEPS = 15
_CLASSES = {
    "upper": (65, 91), "lower": (97, 123), "digit": (48, 58), "other_letter": (128, 256), "control": (0, 9),
}
_SYMBOLS = b"#$%&*+-/<=>@[\\]^_`{|}~"


def _masks() -> np.ndarray:
    """Per byte value, membership in each class as a row."""
    table = np.zeros((9, 256), dtype=np.int32)
    for i, (low, high) in enumerate(_CLASSES.values()):
        table[i, low:high] = 1
    table[5, list(_SYMBOLS)] = 1
    table[6, list(b"!?")] = 1
    table[7, list(b".,;:'\"()")] = 1
    table[8, list(b"\n")] = 1
    return table


def surface(texts: list[bytes]) -> np.ndarray:
    """One row of features per text."""
    table = _masks()
    rows = []
    for a, b in chunks(texts):
        words = Words(texts[a:b], lower=False)
        lengths = words.end - words.start
        codes = np.arange(b - a)
        size = np.diff(np.append(words.base, len(words.buffer))) - 1
        shares = [np.add.reduceat(mask[words.buffer], words.base) - (i == 8) for i, mask in enumerate(table)]
        shares = np.column_stack(shares) / np.maximum(size, 1)[:, None]
        number = np.diff(words.first)
        some = np.maximum(number, 1)
        mean = np.bincount(words.text, lengths, b - a) / some
        spread = np.sqrt(np.maximum(np.bincount(words.text, lengths.astype(float) ** 2, b - a) / some - mean**2, 0))
        order = np.lexsort((words.hash, words.text))
        h, t = words.hash[order], words.text[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        distinct = np.bincount(t[new], minlength=b - a) / some
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        common = np.zeros(b - a)
        np.maximum.at(common, t[new], runs)
        pairs, at = words.shingles(3)
        pair_text = words.text[at]
        order = np.lexsort((pairs, pair_text))
        p, q = pairs[order], pair_text[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        fresh = np.bincount(q[new], minlength=b - a) / np.maximum(np.bincount(pair_text, minlength=b - a), 1)
        last = words.buffer[np.maximum(words.end - 1, 0)] if len(words.end) else words.buffer[:0]
        symbol_end = np.bincount(words.text, table[5][last] + table[6][last], b - a) / some
        short = np.bincount(words.text, lengths <= 2, b - a) / some
        rows.append(np.column_stack((
            shares, mean / 10, spread / 10, distinct, common / some, fresh, symbol_end, short, np.log1p(number) / 10, np.log1p(size) / 10,
        )) * (size > 0)[codes][:, None])
    return np.concatenate(rows) if rows else np.zeros((0, 18))


def features(docs: DataFrame) -> DataFrame:
    """(d, x): id and surface features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = surface(column_bytes(batch.column(1)))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], names=["d", "x"])

    return bounded_batches(docs).selectExpr("CAST(doc_id AS long) AS d", "CAST(text AS string) AS t").where("d IS NOT NULL").mapInArrow(run, "d long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    both = np.column_stack((x, x**2))
    return np.column_stack((np.clip((both - centre) / scale, -8, 8), np.ones(len(x))))


def _summed(rows: DataFrame, task) -> np.ndarray:
    """Sum over tasks of the flat vector that ``task`` makes of (y, x) batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = task(batch.column(0).to_numpy(), _matrix(batch.column(1)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(got))
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def fit(rows: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights, centre and scale from (y, x): y is 1 for a trusted positive, every row is unlabelled text."""
    moments = _summed(rows, lambda y, x: np.concatenate(([len(y), (y == 1).sum()], np.column_stack((x, x**2)).sum(0), (np.column_stack((x, x**2)) ** 2).sum(0))))
    if len(moments) == 0 or not moments[1]:
        return None
    width = (len(moments) - 2) // 2
    total, positives = moments[0], moments[1]
    centre = moments[2:2 + width] / total
    scale = np.sqrt(np.maximum(moments[2 + width:] / total - centre**2, 1e-12)) + 1e-6

    def state(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def task(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = _design(x, centre, scale)
            g = z @ w
            p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            loss = np.logaddexp(0, g)  # l(-g)
            good = y == 1
            sums = [loss.sum(), loss[good].sum(), g[good].sum(), (loss**2).sum(), (loss[good] ** 2).sum()]
            return np.concatenate((sums, z[good].sum(0), z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).ravel()))

        s = _summed(rows, task)
        k = len(w)
        risk = s[0] / total - prior * s[2] / positives + RIDGE / 2 * w @ w
        noise = (s[3] / total - (s[0] / total) ** 2) / total + prior**2 * (s[4] / positives - (s[1] / positives) ** 2) / positives
        unseen = s[0] / total - prior * s[1] / positives + 2 * np.sqrt(max(noise, 0.0))
        gradient = s[5 + k:5 + 2 * k] / total - prior * s[5:5 + k] / positives + RIDGE * w
        hessian = s[5 + 2 * k:].reshape(k, k) / total + RIDGE * np.eye(k)
        return risk, unseen, gradient, hessian

    w = np.zeros(width + 1)
    now = state(w)
    for _ in range(STEPS):
        step = np.linalg.solve(now[3], now[2])
        size = 1.0
        while size > 1e-2:
            ahead = state(w - size * step)
            if ahead[1] >= 0 and ahead[0] < now[0]:
                break
            size /= 2
        else:
            break
        done = now[0] - ahead[0] < 1e-6
        w, now = w - size * step, ahead
        if done:
            break

    def spread(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        g = np.clip(_design(x, centre, scale) @ w, -20, 20)
        return np.bincount(np.rint((g + 20) * 50).astype(np.int64), minlength=2001).astype(float)

    values, number = np.arange(2001) / 50 - 20, _summed(rows, spread)
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        below = (number / (1 + np.exp(-np.clip(values + middle, -40, 40)))).sum() < min(max(prior, 0.01), 0.99) * total
        low, high = (middle, high) if below else (low, middle)
    w[-1] += high
    return w, centre, scale


def quality(docs: DataFrame, labels: DataFrame, fold: str, label: str = "quality") -> DataFrame:
    """(doc_id, score): the probability of good quality, learnt from rows whose id ``d`` satisfies ``fold``."""
    table = materialize(features(docs), "surface")
    marked = labels.selectExpr("CAST(doc_id AS long) AS d", f"CAST({label} AS int) AS y").where("y IS NOT NULL").where(fold).groupBy("d").agg(F.max("y").alias("y"))
    shares = marked.agg(F.avg("y").alias("p")).first()["p"]
    rows = materialize(table.where(fold).join(marked, "d", "left").select(F.coalesce("y", F.lit(0)).alias("y"), "x"), "training")
    model = fit(rows, float(shares)) if shares is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not len(batch):
                p = np.full(len(batch), 0.5)
            else:
                w, centre, scale = model
                p = 1 / (1 + np.exp(-np.clip(_design(_matrix(batch.column(1)), centre, scale) @ w, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return table.select("d", "x").mapInArrow(run, "doc_id long, score double")
