import numpy as np

from tickerloom.llm import neighbours


def brute_force(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), d[i]) for i in order]
    return out


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = np.concatenate((rng.normal(size=(1500, 24)), centres[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 24)), np.tile(centres[:1], (400, 1))))
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), 1, 2) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, b int, t int").repartition(6)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    exact = brute_force(ids, x, range(0, len(x), 100), 10)
    assert set(got) == set(exact)
    hits = 0
    for q, rows in exact.items():
        assert sorted(got[q]) == list(range(1, 11))
        mine = [got[q][i] for i in range(1, 11)]
        assert mine == sorted(mine, key=lambda r: (r[1], r[0]))
        for v, s in mine:
            assert v != q and abs(s - np.sqrt(((x[q] - x[v]) ** 2).sum())) < 1e-12
        hits += len({v for v, _ in mine} & {v for v, _ in rows})
    assert hits >= 0.9 * 10 * len(exact)


def test_split_groups_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i), rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 10 = 0")
    one = sorted(map(tuple, neighbours.nearest(df, queries, 5).collect()))
    monkeypatch.setattr(neighbours, "GROUP_VECTORS", 7)
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", 3)
    assert sorted(map(tuple, neighbours.nearest(df, queries, 5).collect())) == one


def test_odd_vectors_and_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert neighbours.nearest(*[spark.createDataFrame([], schema)] * 2).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, neighbours.nearest(df, df.where("vec_id IN (0, 3, 8)")).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 5**0.5)]
    single = spark.createDataFrame([(0, [1.0])], schema)
    assert neighbours.nearest(single, single).count() == 0


def test_components_of_any_finite_size(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i, scale in enumerate(rng.choice([1.0, 1e200, 1.7e307, 1e-200, 5e-320], 300))]
    rows += [(900, [1.7e308] * 6), (901, [-1.7e308] * 6), (902, [5e-324] + [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id % 100 = 0"), k=5).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200, 900}
    vectors = {i: np.array(v, dtype=np.longdouble) for i, v in rows}
    for r in got:
        exact = float(np.sqrt(((vectors[r["query_id"]] - vectors[r["vec_id"]]) ** 2).sum()))
        assert r["score"] == exact or abs(r["score"] - exact) <= 1e-12 * exact
    for r in neighbours.nearest(table.where("vec_id < 3"), table.where("vec_id = 0"), k=5).collect():
        assert r["score"] > 0
