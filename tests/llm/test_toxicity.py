import random

import numpy as np

from tickerloom.llm import toxicity


def best_segments(scores):
    """All maximal segments by recursion: the best one, then those left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i:j + 1])
            if s > best + 1e-12:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return best_segments(scores[:i]) + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in best_segments(scores[j + 1:])]


def test_linear_scan_finds_all_maximal_segments():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice((-3.0, -2.0, -1.25, -0.5, 0.75, 1.5, 2.25)) + r.random() / 97 for _ in range(r.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        exact = best_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in exact]
        assert np.allclose([s for *_, s in got], [s for *_, s in exact])


def documents(sentence, n=400):
    r, rows, labels = random.Random(3), [], []
    for i in range(n):
        words, toxic = sentence(i, r.randint(20, 120)).split(), int(r.random() < 0.2)
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(("vilescum", "vilerat", "nastyfoo", "vile" + r.choice("abcdefgh"))) for _ in range(5)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, sentence):
    rows, labels = documents(sentence)
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, "d % 4 <> 0")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[d]["score"], y) for d, _, y in labels if d % 4 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) >= 0.95
    marked = {y: np.mean([bool(got[d]["passages"]) for d, _, z in labels if z == y]) for y in (0, 1)}
    assert marked[1] > 0.5 and marked[0] < 0.05
    passage = next(r for r in got.values() if r["passages"])["passages"][0]
    assert passage["first"] <= passage["last"] and 0 <= passage["p_value"] <= toxicity.SIGNIFICANT
    # Labels of the held-out fold do not matter.
    other = spark.createDataFrame([(d, q, 1 - t if d % 4 == 0 else t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, other, "d % 4 <> 0")).collect()}
    assert again == {d: r["score"] for d, r in got.items()}


def test_odd_rows(spark, sentence):
    rows, labels = documents(sentence, 120)
    odd = [(900, None), (901, ""), (902, " \n"), (903, "w" * 100_000), (904, "a " * 60_000), (900, None), (None, "x"), (905, "ÄÖ vileSCUM, VILEscum! vilescum")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (900, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), "true")
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 7 and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[900] == scores[901] == scores[902] and scores[905] > 0.5
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), "true")
    assert nothing is None and {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
