import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm import suffix_dedup
from tickerloom.llm.suffix_dedup import MATCH, SIDE, Runs, SuffixLevels, _array, in_order, meeting, ordered, repeated_bytes, slice_numbers
from tickerloom.scratch import materialize


def brute_force(rows):
    first = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - MATCH + 1):
            first.setdefault(b[i:i + MATCH], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - MATCH + 1):
            if first[b[i:i + MATCH]] < d:
                gone[i:i + MATCH] = b"\1" * MATCH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, bytes([0]) + bytes(gone), strict=False))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def documents(sentence):
    r = random.Random(11)
    texts = [sentence(i, 60) for i in range(10)]
    passage = sentence(77, 30)
    for i in range(30):
        text = sentence(200 + i, 30)
        cut = r.randrange(len(text))
        a = r.randrange(40)
        texts.append(text[:cut] + passage[a:a + r.choice((48, 49, 50, 51, 52, 70, 150, 300))] + text[cut:])
    base = texts[4]
    for i in range(12):
        at = r.randrange(len(base))
        texts.append(base[:at] + "é" + base[at + r.randrange(3):])
    texts += [texts[2]] * 3 + [None, "", "short", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 500, "ab" * 200, "ab" * 30, base[100:149], base[100:150], "é" * 25, "xé" * 80]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def test_removals_equal_all_windows(spark, sentence):
    rows = documents(sentence)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, d int, run string").repartition(4)
    exact = brute_force(rows)
    for batches in ((1,), (0.1, 0.9), (1, 1, 1, 1, 1)):
        got = [tuple(r) for r in repeated_bytes(df, batches).collect()]
        assert len(got) == len(rows)
        assert {r[0]: r[1:] for r in got} == exact


def test_levels_merge_geometrically(spark, sentence):
    family, union = SuffixLevels(), None
    for i in range(7):
        rows = spark.createDataFrame([(i, sentence(i % 4, 40))], "h long, t string")
        family.add(materialize(_array(rows), "array"))
        union = rows if union is None else union.union(rows)
    assert [size for size, _ in family.levels] == [4, 2, 1]
    assert sum(t.count() for _, t in family.levels) == sum(_array(union.where(F.col("h") == i)).count() for i in range(7))
    hit = family.scan(_array(spark.createDataFrame([(9, sentence(3, 40))], "h long, t string")))
    assert {r["h"] for r in hit.collect()} == {0, 4, 1, 5, 2, 6, 3, 9}


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert repeated_bytes(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "q" * 80), (1, "q" * 80), (1, "q" * 80), (2, "q" * 60)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeated_bytes(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0), (2, 60)]


def test_levels_are_slices_in_the_order_of_suffix_bytes(spark, sentence):
    family, texts = SuffixLevels(), [sentence(i, 300) + " é" * 20 for i in range(4)]
    for i, text in enumerate(texts):
        family.add(materialize(in_order(_array(spark.createDataFrame([(i, text)], "h long, t string"))), "array"))
    (size, level), = family.levels
    rows = [tuple(r) for r in level.withColumn("p", F.input_file_name()).orderBy("p", F.monotonically_increasing_id()).select("x", "y", "run").collect()]
    heads = [b"".join((v + (1 << 63)).to_bytes(8, "big") for v in r[:2]) for r in rows]
    assert size == 4 and rows == sorted(rows) and heads == sorted(heads)
    assert all(any(h in t.encode() for t in texts) for h in heads)


def test_query_builds_scans_and_merges_levels(spark, sentence, monkeypatch):
    sizes, add = [], SuffixLevels.add
    monkeypatch.setattr(SuffixLevels, "add", lambda self, array, size=1: (add(self, array, size), sizes.append([s for s, _ in self.levels])))
    rows = documents(sentence)
    got = {r[0]: tuple(r)[1:] for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]


def test_a_row_of_a_level_is_returned_by_one_scan(spark, sentence):
    family, seen = SuffixLevels(), []
    for i, text in enumerate((1, 1, 2, 1, 2)):
        array = materialize(_array(spark.createDataFrame([(i, sentence(text, 40))], "h long, t string")), "array")
        seen.append({r["h"] for r in family.scan(array, again=False).collect()})
        family.add(array)
    assert seen == [set(), {0, 1}, set(), {3}, {2, 4}]


def test_only_runs_with_common_bytes_beside_the_head_are_looked_at_window_by_window(spark, sentence):
    letters = random.Random(5)
    common = [sentence(i, 40)[7 * i:][:SIDE - 4] for i in range(40)]
    rows = [(d, " ".join("".join(letters.choice("abcdefgh") for _ in range(60)) + c for c in common)) for d in range(12)]
    rows += [(20 + d, rows[d][1][100 + d:100 + d + 49 + d]) for d in range(12)]
    texts = spark.createDataFrame(rows, "d long, t string")
    open_runs, sharing, holders = set(), set(), {}
    for d, t in rows:
        runs = Runs([t.encode()])
        for r, (key, start, number) in enumerate(zip(runs.key.tolist(), runs.start.tolist(), runs.number.tolist(), strict=True)):
            open_runs.add((d, key))
            for w in range(start, start + number):
                holders.setdefault(t[w:w + MATCH], set()).add((key, d))
    for held in holders.values():
        if len({k for k, _ in held}) > 1:
            sharing |= {(d, k) for k, d in held}
    met = {tuple(r) for r in meeting(texts, spark.createDataFrame(sorted(open_runs), "d long, k long")).collect()}
    assert sharing and sharing <= met and 2 * len(met) < len(open_runs)
    exact = brute_force(rows)
    got = {r[0]: tuple(r)[1:] for r in repeated_bytes(texts.withColumnRenamed("d", "doc_id").withColumnRenamed("t", "text")).collect()}
    assert got == exact


def test_a_text_is_taken_apart_once_besides_the_sample(spark, sentence, monkeypatch):
    seen, suffixes = spark.sparkContext.accumulator(0), suffix_dedup._suffixes

    def counted(batches):
        def each():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return suffixes(each())

    monkeypatch.setattr(suffix_dedup, "_suffixes", counted)
    rows = [(d, sentence(d % 300, 12)) for d in range(400)]
    got = {r[0]: tuple(r)[1:] for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), (1, 1, 1)).collect()}
    assert got == brute_force(rows)
    assert 300 <= seen.value < 400


def test_a_frequent_head_goes_over_many_slices(spark, sentence, monkeypatch):
    cuts, bounds_of = [], suffix_dedup.order_bounds
    monkeypatch.setattr(suffix_dedup, "order_bounds", lambda array, slices: cuts.append(bounds_of(array, slices)) or cuts[-1])
    line = sentence(501, 8)
    rows = [(d, line[d % 3:] + " " + sentence(900 + d % 2, 3)[:5 + d % 7] + " " + line + chr(97 + d % 11) * 3) for d in range(90)]
    rows += [(200 + d, sentence(d, 30) + line[:30 + d]) for d in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        got = {r[0]: tuple(r)[1:] for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), (1, 1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    heads = [tuple(c) for c in cuts[0][:2].T.tolist()]
    assert len(set(heads)) < len(heads) == 23
    assert got == brute_force(rows)


def test_scans_and_merges_sort_no_rows_in_spark(spark, sentence):
    family = SuffixLevels()
    for i in range(2):
        family.add(materialize(_array(spark.createDataFrame([(i, sentence(1, 40))], "h long, t string")), "array"))
    scan = family.scan(materialize(_array(spark.createDataFrame([(5, sentence(1, 40))], "h long, t string")), "array"), again=False)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert {r["h"] for r in scan.collect()} == {5}
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan


def test_columns_are_ordered_and_sliced_as_longs(spark):
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 500):
        rows = np.stack([r.integers(-2, 3, n) << int(k) for k in (61, 40, 0, 20)])
        for by in (2, 4):
            got = [tuple(c) for c in ordered(rows, by).T.tolist()]
            assert [c[:by] for c in got] == sorted(c[:by] for c in got) and sorted(got) == sorted(map(tuple, rows.T.tolist()))
        bounds = ordered(rows)[:, ::60]
        assert slice_numbers(bounds, rows).tolist() == [sum(b <= c for b in bounds.T.tolist()) for c in rows.T.tolist()]


def test_slices_grow_in_number_with_the_texts(spark, sentence, monkeypatch):
    cuts, bounds_of = [], suffix_dedup.order_bounds
    monkeypatch.setattr(suffix_dedup, "order_bounds", lambda array, slices: cuts.append(slices) or bounds_of(array, slices))
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2000)
    rows = [(d, sentence(d % 25, 60)) for d in range(30)]
    got = {r[0]: tuple(r)[1:] for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), (1, 1)).collect()}
    assert got == brute_force(rows)
    assert cuts == [-(-sum(len(t) for _, t in rows) // 2000)]


def test_steps_leave_no_shuffle_files(spark, sentence):
    kept = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = kept.size(), spark.conf.get(name, None)
    rows = [(d, sentence(d % 7, 30)) for d in range(12)]
    result = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), (1, 1))
    assert kept.size() <= before and spark.conf.get(name, None) == setting
    assert sorted(result.collect()) == sorted(result.collect())
    assert {r[0]: tuple(r)[1:] for r in result.collect()} == brute_force(rows)
