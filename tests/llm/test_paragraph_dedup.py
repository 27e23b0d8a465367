import numpy as np

from tickerloom.llm.paragraph_dedup import LEAST_WORDS, Cut, odd_sketches, repeated_paragraphs, tuned, wanted_sets, without_repeats
from tickerloom.llm.text import Words, positive
from tickerloom.llm.text import paragraphs as cuts


def paragraphs(text):
    """Plain restatement for texts without sentences of over 40 words."""
    out, part, words = [], [], 0
    for line in (text or "").split("\n"):
        line = line.split()
        for i, w in enumerate(line):
            part.append(w.lower())
            words += 1
            if w[-1] in ".!?" or i == len(line) - 1:
                if words >= 6:
                    out.append(tuple(part))
                    part = []
                words = 0
    return out + ([tuple(part)] if part else [])


def brute_force(rows):
    seen = [(d, p, u) for d, t in sorted(rows) for p, u in enumerate(paragraphs(t)) if len(u) >= 6]
    grams = [frozenset(u[i:i + 5] for i in range(len(u) - 4)) for _, _, u in seen]
    group = list(range(len(seen)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(seen)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if 100 * both >= 80 * len(grams[i] | grams[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return {(d, p): (seen[root(i)][0], seen[root(i)][1]) for i, (d, p, _) in enumerate(seen) if root(i) != i}


def documents(sentence):
    passage = " ".join(f"{sentence(s, 9 + s % 5).capitalize()}." for s in range(500, 506))
    long = sentence(700, 38).split()
    rows = []
    for i in range(40):
        own = f"{sentence(1000 + i, 12)}. {sentence(2000 + i, 7)}.\nShort one. {sentence(3000 + i, 20)}!"
        text = own if i % 4 else f"{own} {sentence(4000 + i, 3)} {passage} {sentence(5000 + i, 9)}"
        if i % 7 == 0:  # near copies of one long paragraph
            near = list(long)
            near[-1 - i // 7 % 2] = f"edit{i}"
            text += "\n" + " ".join(near) + "."
        rows.append((i, text))
    return rows + [(90, None), (91, ""), (92, " \n "), (93, rows[3][1]), (94, "one two three. one two three.")]


def test_removals_equal_all_pairs(spark, sentence):
    rows = documents(sentence)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, k string, p int").repartition(4)
    got = {(r["doc_id"], r["paragraph"]): (r["kept_doc_id"], r["kept_paragraph"]) for r in repeated_paragraphs(df).collect()}
    assert got == brute_force(rows)


def test_passage_stays_once_and_clean_texts_are_untouched(spark, sentence):
    rows = documents(sentence)
    df = spark.createDataFrame([(d, t, "clash", len(t or "")) for d, t in rows] + [(None, rows[0][1], "x", 1)], "doc_id long, text string, k string, n_chars long")
    got = without_repeats(df)
    assert got.columns == df.columns
    out = {r["doc_id"]: r for r in got.collect()}
    middle = f"{sentence(502, 11).capitalize()}. {sentence(503, 12).capitalize()}."
    assert sum(middle in (r["text"] or "") for r in out.values()) == 2  # the first document and the row without id
    assert 93 not in out and out[90]["text"] is None and out[91]["text"] == "" and out[94]["text"] == rows[-1][1]
    for d, t in rows:
        if d < 40 and d % 4 and d % 7 and d not in (3,):
            assert out[d]["text"] == t
    assert all(r["n_chars"] == len(r["text"]) for r in out.values() if r["text"] and r["doc_id"] is not None and r["doc_id"] < 90)


def test_pairs_at_the_threshold_are_found(spark, sentence):
    """1,000 pairs of similarity 16 / 20; three bands of one row miss about 8."""
    rows = []
    for i in range(1000):
        words = sentence(50000 + i, 24).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:20]))]
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["kept_doc_id"], r["doc_id"]) for r in got} >= {(2 * i, 2 * i + 1) for i in range(1000)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_paragraphs(df).count() == 0 and without_repeats(df).count() == 0


def test_tuned_bands_reach_the_recall():
    for percent in (50, 70, 80, 90):
        bands, rows = tuned(percent)
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= 0.99
        assert bands == 1 or 1 - (1 - percent / 100) ** (bands - 1) < 0.99


def test_passages_of_short_lines_and_of_unpunctuated_words_stay_once(spark, sentence):
    """60 words in lines of 1 to 5 words, or in one piece, between different neighbours, at a sentence's start and deep in one."""
    for size in (1, 3, 5, 60):
        words = sentence(600 + size, 60).split()
        passage = "\n".join(" ".join(words[i:i + size]) for i in range(0, 60, size))
        rows = []
        for i in range(8):
            if size < 60:
                before = "\n".join(sentence(8000 + 100 * i + j, 4) for j in range(i)) or f"{sentence(8000 + i, 20)}."
                rows.append((i, f"{before}\n{passage}\n{sentence(9000 + i, 20)}. {sentence(9500 + i, 20)}."))
            else:
                rows.append((i, f"{sentence(8000 + i, 15 * i) + ' ' if i else ''}{passage} {sentence(9000 + i, 30)}."))
        out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        left = [sum(w in set((r["text"] or "").split()) for w in set(words)) / len(set(words)) for r in out if r["doc_id"]]
        assert len(left) == 7 and sum(left) / 7 < 0.45 and max(left) < 0.75, (size, left)


def test_equal_short_lines_are_cut(sentence):
    for text in (b"one two three\n" * 500, b"x " * 900):
        last = cuts(Words([text]), LEAST_WORDS)
        assert max(b - a for a, b in zip([-1, *last[:-1]], last, strict=True)) <= 60


def test_sets_of_many_texts_equal_those_of_single_ones(sentence):
    """Wanted classes of a chunk, some of them in several texts, from one cut of all texts; an odd sketch counts values modulo two."""
    texts = [(t or "").encode() for _, t in documents(sentence)]
    expected = {}
    for text in texts:
        cut = Cut([text])
        values, unit = cut.shingles()
        expected |= {int(cut.key[u]): np.unique(values[unit == u]) for u in np.unique(unit).tolist()}
    picked = sorted(expected)[::3]
    keys, begin, values = wanted_sets(Cut(texts), np.array([*picked, 17], dtype=np.int64))
    assert keys.tolist() == picked
    marks = odd_sketches(values, begin)
    for i, (k, own) in enumerate(zip(picked, np.split(values, begin[1:]), strict=True)):
        assert own.tolist() == positive(expected[k]).tolist()
        bits = [0, 0]
        for v in own.tolist():
            bits[0 if v & 64 else 1] ^= 1 << (v & 63)
        assert [int(m[i]) % (1 << 64) for m in marks] == bits
    assert [len(x) for x in wanted_sets(Cut(texts), np.array([17], dtype=np.int64))] == [0, 0, 0]
    assert [len(x) for x in wanted_sets(Cut([b""]), np.array(picked, dtype=np.int64))] == [0, 0, 0]
