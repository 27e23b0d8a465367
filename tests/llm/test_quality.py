import random

import numpy as np

from tickerloom.llm import quality


def documents(sentence, n=400):
    r, rows, labels = random.Random(4), [], []
    for i in range(n):
        text, good = sentence(i, r.randint(20, 120)), int(r.random() < 0.8)
        if not good:
            text = r.choice((text.upper().replace(" ", "!! "), text.replace(" ", " | "), (text[:30] + "\n") * 20))
        rows.append((i, text))
        labels.append((i, good, 0))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, sentence):
    rows, labels = documents(sentence)
    docs = spark.createDataFrame([(*x, 1.0, 2) for x in rows], "doc_id long, text string, x double, y int")
    # Only positives and the prior are learnt from labels: which rows are bad is never told.
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, marks, "d % 4 <> 2").collect()}
    held = [(got[d] >= 0.7, y) for d, y, _ in labels if d % 4 == 2]
    assert np.mean([p == bool(y) for p, y in held]) >= 0.9
    other = spark.createDataFrame([(d, 1 - q if d % 4 == 2 else q, t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, other, "d % 4 <> 2").collect()}
    assert max(abs(again[d] - s) for d, s in got.items()) < 1e-9


def test_odd_rows(spark, sentence):
    rows, labels = documents(sentence, 60)
    odd = [(900, None), (901, ""), (902, "w" * 100_000), (903, "a " * 60_000), (900, None), (None, "x"), (904, "\n\n")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (901, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, marks, "true").collect()
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[900] == scores[901]
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs, empty, "true").collect()} == {0.5}
    assert quality.quality(docs.limit(0), marks, "true").count() == 0
