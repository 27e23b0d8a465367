import random
import re

from tickerloom.llm import near_dedup
from tickerloom.llm.graph import components
from tickerloom.llm.near_dedup import SKETCH, near_duplicates, prefix_length
from tickerloom.llm.text import shingle_sets


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute_force(rows, n, percent):
    """Components by comparing all pairs."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_components_equal_all_pairs(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    for n in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(corpus, words=n).collect()}
        assert got == brute_force(rows, n, 80)


def test_borderline_pairs(spark):
    """Similarities at, just above and just below 0.8 in short sets, where one shingle decides."""
    texts = []
    for size in range(4, 30):
        words = [f"w{size}x{i}" for i in range(size)]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join(words[:-2]), " ".join(words[1:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, words=2).collect()}
    assert got == brute_force(list(enumerate(texts)), 2, 80)


def test_appended_copies_meet(spark, sentence):
    """Texts of 400 shingles with 100 appended, those pairs whose sketches share fewer than 42 values."""
    rows = []
    for i in range(4000):
        words = sentence(70000 + i, 504).split()
        pair = [" ".join(words), " ".join(words[:404])]
        whole, part = (set(s[:SKETCH].tolist()) for s in shingle_sets([t.encode() for t in pair], 5))
        if len(whole & part) < 42:
            rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    assert rows
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 2 * (d // 2) for d, _ in rows}


def test_pairs_of_a_group_grow_with_its_members(spark, sentence, monkeypatch):
    """Copies of one text with a sixth of their words changed: alike, hardly linked, no pair of all of them is looked at."""
    r, base, rows = random.Random(3), sentence(5, 150).split(), []
    for i in range(200):
        words = [f"c{i}x{j}" if r.random() < 0.16 else w for j, w in enumerate(base)]
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:  # its own near copy, and one at exactly the threshold's border
            rows.append((2 * i + 1, " ".join([*words, f"end{i}"] if i % 20 else words[:-30])))
    seen = []

    def counted(pairs, sets):
        seen.append(pairs.count())
        return estimated(pairs, sets)

    estimated = near_dedup.estimated
    monkeypatch.setattr(near_dedup, "estimated", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == brute_force(rows, 2, 80)
    assert sum(seen) < 10 * len(rows)


def test_prefix_pairs_hold_every_similar_pair(spark):
    """Sets of all sizes around the threshold, within and across components."""
    r, rows = random.Random(11), []
    for group in range(12):
        base = [r.randrange(1 << 60) for _ in range(r.randint(1, 60))]
        for _ in range(14):
            kept = [x for x in base if r.random() > r.choice((0, 0.05, 0.1, 0.2))] or base[:1]
            rows.append((len(rows), group if r.random() < 0.2 else len(rows) + 100, (0, 0), kept + [r.randrange(1 << 60) for _ in range(r.randint(0, len(base) // 8))]))
    table = spark.createDataFrame(rows, "d long, c long, g struct<x: long, y: long>, s array<bigint>")
    got = {(x["a"], x["b"]) for x in near_dedup.prefix_pairs(table, 80, "true").collect()}
    sets = {d: (c, set(s)) for d, c, _, s in rows}
    wanted = {(a, b) for a in sets for b in sets if a < b and sets[a][0] != sets[b][0] and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])}
    assert len(wanted) > 100 and wanted <= got


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (3, None)], schema)
    rows = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert rows == [(1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_prefix_keeps_one_shared_value():
    for size in range(1, 200):
        kept = min(size, 64)
        assert 1 <= prefix_length(size, 80) <= kept


def test_components_of_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 90)] + [(5, 5), (2, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 90)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
