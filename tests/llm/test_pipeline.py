import os

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute_force as benchmark_pairs
from tests.llm.test_near_dedup import brute_force as near_components
from tests.llm.test_paragraph_dedup import brute_force as repeated

from tickerloom.llm.near_dedup import one_of_each
from tickerloom.llm.paragraph_dedup import cut_out, without_repeats
from tickerloom.scratch import materialize, scratch_root, temporary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_against_brute_force(spark, sentence, tmp_path):
    items = [(i, sentence(900 + i, 24)) for i in range(3)]
    passage = " ".join(f"{sentence(s, 11).capitalize()}." for s in range(500, 506))
    rows = []
    for i in range(90):
        parts = [f"{sentence(1000 + i, 14).capitalize()}.", f"{sentence(2000 + i, 30).capitalize()}."]
        if i % 6 == 0:
            parts.insert(1, "vilescum utter vilescrew vilesque vileston")
        if i % 7 == 1:
            parts.insert(1, passage)
        if i % 11 == 2:
            parts.append(items[i % 3][1])
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 90, 4)] + [(300, None), (301, ""), (302, "tiny")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int("vile" in (t or ""))) for d, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in seen.items() if n != "packing"}
    assert texts["toxicity"] == {d: t for d, t in rows if "vile" not in (t or "")}
    groups = near_components(list(texts["toxicity"].items()), 5, 80)
    assert texts["near_dedup"] == {d: t for d, t in texts["toxicity"].items() if groups[d][1] == d}
    gone = repeated(list(texts["near_dedup"].items()))
    assert gone and set(texts["paragraph_dedup"]) == set(texts["near_dedup"])
    for d, t in texts["paragraph_dedup"].items():
        before = texts["near_dedup"][d]
        if not any(x == d for x, _ in gone):
            assert t == before
        else:
            assert len(t) < len(before)
    hits = {d for d, _ in benchmark_pairs(list(texts["paragraph_dedup"].items()), items)}
    assert hits and texts["decontamination"] == {d: t for d, t in texts["paragraph_dedup"].items() if d not in hits}
    packed = {tuple(r) for r in seen["packing"].select("doc_id", "piece", "start", "length", "ids_crc32").collect()}
    assert {r[0] for r in packed} == set(texts["decontamination"])
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()}
    assert whole == packed


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "one two three four five six seven eight nine ten."
    odd = [(None, text, None, None, None), (1, None, None, None, None), (2, text, "en", "s", 49), (2, text, "en", "s", 49), (3, "", "en", "s", 0)]
    for rows, left in ((odd, {(None, text), (1, None), (2, text), (3, "")}), ([], set())):
        docs = spark.createDataFrame(rows, COLUMNS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        got = [tuple(r) for r in docs.select("doc_id", F.col("text")).collect()]
        assert set(got) == left and len(got) == len(left)


def test_cut_out_keeps_bytes_around():
    assert cut_out(b"  A b c.\n", {(9, 9)}) == b"  A b c.\n"


def test_stages_leave_only_what_their_results_read(spark, corpus):
    docs = corpus.selectExpr("doc_id", "concat(text, '.') AS text")

    def stored():
        made = os.path.join(scratch_root(spark).removeprefix("file:"), "tickerloom", spark.sparkContext.applicationId)
        return {x.rsplit("-", 1)[0]: x for x in os.listdir(made)} if os.path.isdir(made) else {}

    for stage, names in ((one_of_each, {"dropped", "repeated"}), (without_repeats, {"removed"})):
        before = set(stored().values())
        assert stage(docs).count() > 0
        assert {n for n, x in stored().items() if x not in before} == names


def test_temporary_tables_go_at_the_end_of_their_scope(spark):
    paths = {}
    with temporary(spark) as outer:
        with temporary(spark) as inner:
            paths = {n: materialize(spark.range(3), n) for n in ("a", "b", "c")}
            inner(paths["b"])
            inner(paths["c"])
        assert [os.path.isdir(paths[n]._scratch_path) for n in "abc"] == [False, True, True]
        outer(paths["c"])
    assert [os.path.isdir(paths[n]._scratch_path) for n in "abc"] == [False, False, True]
    assert paths["c"].count() == 3
