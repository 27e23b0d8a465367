import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("na", "re", "st", "mi", "lo", "vu", "za")]


@pytest.fixture(scope="session")
def sentence():
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(spark, sentence):
    """Documents with copies, near copies, odd texts, extra clashing columns; every id once."""
    r = random.Random(7)
    texts = [sentence(i, 20 + 7 * i) for i in range(12)]
    base = texts[5].split()
    for j in range(25):  # a hot group of near copies
        edited = list(base)
        for _ in range(r.randint(0, 3)):
            edited[r.randrange(len(edited))] = f"edit{j}"
        texts.append(" ".join(edited))
    texts += [texts[3]] * 20 + [texts[3].upper()]
    texts += [None, "", "   \n", "one", "one", "One Two", "ÄÖ é", "x " * 3000, sentence(99, 4000), "w" * 5000]
    rows = [(i, t, "n", "v", "d", i) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, n string, v string, d string, c long").repartition(5).cache()
