import numpy as np

from tickerloom.llm.decontaminate import BLOCKS, RADIUS, _block_rows, benchmark_matches, decontaminated, similarity


def brute_force(docs, items):
    """Best window over all windows of each item's length."""
    out = {}
    for d, text in docs:
        words = (text or "").lower().encode().split()
        for i, item in items:
            target = (item or "").lower().encode().split()
            if d is None or i is None or len(target) < 5 or len(words) < 5:
                continue
            size = min(len(target), len(words))
            found = [(-similarity(words[p:p + size], target), p) for p in range(len(words) - size + 1)]
            if found and min(found)[0] <= -0.8:
                out[d, i] = (min(found)[1], -min(found)[0])
    return out


def tables(sentence):
    items = [(i, sentence(100 + i, 16 + 5 * i)) for i in range(9)] + [(20, "too short"), (21, None), (22, sentence(103, 31)), (None, sentence(101, 21))]
    docs = []
    for d in range(60):
        own, passage = sentence(300 + d, 40).split(), items[d % 9][1].split()
        if d % 5 == 1:
            own[17:17] = passage
        elif d % 5 == 2:
            own[30:30] = [w.upper() for w in passage[:-1]]
        elif d % 5 == 3:
            passage[1] = "changed"
            own[0:0] = passage
        elif d % 5 == 4:
            own[5:5] = passage[: len(passage) // 2]
        docs.append((d, " ".join(own)))
    docs += [(70, items[4][1]), (71, " ".join(items[5][1].split()[:-2])), (72, None), (73, ""), (74, "a b c"), (75, docs[1][1]), (None, docs[1][1])]
    return docs, items


def test_matches_equal_all_windows(spark, sentence):
    docs, items = tables(sentence)
    d = spark.createDataFrame([(a, b, "x", 3) for a, b in docs], "doc_id long, text string, item_id string, m int").repartition(3)
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["position"], r["similarity"]) for r in benchmark_matches(d, i).collect()}
    exact = brute_force(docs, items)
    assert set(got) == set(exact) and len(got) > 25
    for key, (position, value) in exact.items():
        assert got[key][0] == position and abs(got[key][1] - value) < 1e-12
    kept = decontaminated(d, i)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({a for a, _ in docs if a is not None} - {a for a, _ in exact}) and None in ids


def test_blocks_reach_the_radius(spark):
    """Fingerprints up to the radius apart share a block row; the blocks cover all bits once."""
    assert sorted(x for start, width in BLOCKS for x in range(start, start + width)) == list(range(64))
    rng = np.random.default_rng(2)
    rows = []
    for i in range(2000):
        f = int(rng.integers(-(1 << 63), 1 << 63))
        difference = sum(1 << b for b in rng.choice(64, RADIUS if i % 2 else rng.integers(0, RADIUS + 1), replace=False).tolist())
        rows.append((i, f, int((np.array([f]).view(np.uint64) ^ np.uint64(difference)).view(np.int64)[0])))
    pairs = spark.createDataFrame(rows, "i long, f long, g long")
    near = pairs.selectExpr("i", f"inline({_block_rows(True)})")
    own = pairs.selectExpr("i", "g AS f").selectExpr("i", f"inline({_block_rows(False)})")
    assert near.join(own, ["i", "b", "v"]).select("i").distinct().count() == len(rows)
    assert near.where("i = 0").count() == sum(width + 1 for _, width in BLOCKS) == 74


def test_items_cut_to_the_threshold_are_found(spark, sentence):
    """Items of 40 words quoted without 4 of them, similarity 0.8 and more: about one in 30 is missed with a radius of 11."""
    items = [(i, sentence(9000 + i, 40)) for i in range(400)]
    docs = []
    for i, text in items:
        words, own = text.split(), sentence(20000 + i, 30).split()
        own[15:15] = words[:-4] if i % 2 else words[4:]
        docs.append((i, " ".join(own)))
    due = {(d, d) for d, text in docs if any(similarity(text.encode().split()[p:p + 40], items[d][1].encode().split()) >= 0.8 for p in range(27))}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(due) > 150
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_matches(d, i).collect()} == due


def test_wide_gaps_do_not_count(spark, sentence):
    """One changed word next to 300 blanks, inside the passage."""
    item = sentence(77, 60)
    words = item.split()
    words[30] = " " * 300 + "changed"
    docs = [(1, f"{sentence(78, 30)} {' '.join(words)} {sentence(79, 30)}"), (2, "\t\n ".join(item.split()))]
    got = benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["position"]): r["similarity"] > 0.8 for r in got.collect()} == {(1, 30): True, (2, 0): True}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert benchmark_matches(docs, items).count() == 0 and benchmark_matches(full, items).count() == 0
    assert decontaminated(full, items).count() == 1
