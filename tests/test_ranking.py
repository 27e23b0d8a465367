import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import factors as FA
from tickerloom.operators import grid as G
from tickerloom.operators import ranking as RK


def frame(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "g": rng.choice(["hot", "a", "b"], n, p=[0.8, 0.15, 0.05]), "x": np.round(rng.normal(size=n), 1), "y": rng.normal(size=n), "id": np.arange(n),
    })


def test_positions_count_rows_ahead(spark):
    pdf = frame(spark)
    got = RK.positions(spark.createDataFrame(pdf), ["g"], ["x", "id"]).toPandas().set_index("id")
    for _, s in pdf.sort_values(["x", "id"]).groupby("g"):
        mine = got.loc[s.id]
        assert (mine._before.to_numpy() == np.arange(len(s))).all() and (mine._dense.to_numpy() == np.arange(len(s)) + 1).all()
        assert (mine._total == len(s)).all() and (mine._distinct == len(s)).all()


def test_weighted_positions_count_ties_once(spark):
    pdf = frame(spark)
    got = RK.value_positions(spark.createDataFrame(pdf), ["g"], "x").toPandas().set_index(["g", "x"])
    for g, s in pdf.groupby("g"):
        for x in s.x.unique():
            row = got.loc[(g, x)]
            assert row._before == (s.x < x).sum() and row._n == (s.x == x).sum()
            assert row._total == len(s) and row._distinct == s.x.nunique()


def test_missing_group_keys_are_a_group(spark):
    rows = [("a", None, 1.0, 1), (None, 1, 5.0, 2), (None, 1, 4.0, 3), (None, None, 2.0, 4)]
    got = RK.positions(spark.createDataFrame(rows, "g string, h int, x double, id int"), ["g", "h"], ["x", "id"]).collect()
    assert {r["id"]: (r["_before"], r["_total"]) for r in got} == {1: (0, 1), 2: (1, 2), 3: (0, 2), 4: (0, 1)}


def test_quantiles_are_exact(spark):
    pdf = frame(spark)
    got = RK.quantiles(spark.createDataFrame(pdf), ["g"], "y", {"q1": (1, 4), "med": (1, 2), "p90": (9, 10)}).toPandas().set_index("g")
    for g, s in pdf.groupby("g").y:
        np.testing.assert_allclose(got.loc[g, ["q1", "med", "p90"]].astype(float), s.quantile([0.25, 0.5, 0.9]), rtol=1e-12)


def test_value_buckets_match_quantile_cuts(spark):
    pdf = frame(spark).rename(columns={"g": "factor"}).assign(target_col="t")
    rows = spark.createDataFrame(pdf)
    got = FA.value_buckets(rows, FA.KEYS, 10).select("id", "bucket").toPandas().set_index("id").bucket
    for _, s in pdf.groupby("factor"):
        if s.x.nunique() <= 10:
            exp = s.x.rank(method="dense")
        else:
            exp = pd.qcut(s.x, 10, labels=False, duplicates="drop") + 1
        assert (got.loc[s.id].to_numpy() == exp.to_numpy()).mean() > 0.99


def test_rank_buckets_small_groups(spark):
    for n, q in ((1, 10), (3, 10), (12, 10), (100, 7)):
        rows = spark.range(n).select(F.lit("f").alias("factor"), F.lit(1.0).alias("x"), "id")
        got = sorted(r["bucket"] for r in FA.rank_buckets(rows, ["factor"], q, ["id"]).collect())
        exp = sorted(int(b) + 1 for b in pd.qcut(np.arange(1, n + 1), min(q, n), labels=False)) if n > 1 else [1]
        assert got == exp, (n, q)


def test_correlations_with_ties_and_constants(spark):
    pdf = frame(spark)
    pdf.loc[pdf.g == "b", "x"] = 0.1
    got = RK.correlations(spark.createDataFrame(pdf), ["g"], "x", "y").toPandas().set_index("g")
    for g, s in pdf[pdf.g != "b"].groupby("g"):
        np.testing.assert_allclose(got.loc[g, "pearson_ic"], s.x.corr(s.y), rtol=1e-9)
        np.testing.assert_allclose(got.loc[g, "spearman_ic"], s.x.rank().corr(s.y.rank()), rtol=1e-9)
    assert pd.isna(got.loc["b", "spearman_ic"]) and pd.isna(got.loc["b", "pearson_ic"])


def test_infinite_factor_values_are_missing(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("nan"), 1.0), (2.0, 1.0), (3.0, 2.0)], "f double, t double")
    assert FA.factor_target_rows(df, ["f"], ["t"]).count() == 2
    assert FA.factor_columns(df, ["t"]) == ["f"]


def test_ranks_in_place_carry_ties_over_slices(spark):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "b"], n, p=[0.9, 0.1]), "x": rng.choice([0.0, 1.0, 1.0, 1.0, 1.0, 2.5, -3.0], n), "id": np.arange(n), "a": rng.integers(0, 2, n), "b": rng.integers(0, 2, n)})
    got = RK.ranks_in_place(spark.createDataFrame(pdf), ["g"], "x", "id", ["1", "a", "b"], {"name": ["'one'", "'a'", "concat('b', id)"]}, keep=["id"]).collect()
    assert len(got) == n
    whole = pdf.set_index("id")
    for r in got:
        mine = whole[whole.g == r.g]
        for i, w in enumerate((np.ones(len(mine), dtype=int), mine.a, mine.b)):
            s = r.ranks[i]
            assert (s.before, s.ties, s.total) == (w[mine.x < r.x].sum(), w[mine.x == r.x].sum(), w.sum())
        assert [s.name for s in r.ranks] == ["one", "a", f"b{r.id}"] and r.ranks[1].w == whole.a[r.id]


def test_ranks_in_place_without_keys_and_rows(spark):
    rows = spark.createDataFrame([(x, i) for i, x in enumerate([5.0, 5.0, 1.0])], "x double, id long")
    got = RK.ranks_in_place(rows, [], "x", "id", ["1"]).collect()
    assert sorted((r.x, r.ranks[0].before, r.ranks[0].ties, r.ranks[0].total) for r in got) == [(1.0, 0, 1, 3), (5.0, 1, 2, 3), (5.0, 1, 2, 3)]
    assert RK.ranks_in_place(rows.where("x > 9"), [], "x", "id", ["1"]).collect() == []


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_correlation_grid_equals_pandas(spark, batch):
    """Runs of equal values also go over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        _grid_equals_pandas(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _grid_equals_pandas(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b", None], n, p=[0.8, 0.15, 0.05]), "x1": np.round(rng.normal(size=n), 1), "x2": rng.integers(0, 3, n).astype(float), "x3": 7.0, "y1": np.round(rng.normal(size=n), 2)})
    pdf["y2"] = pdf.y1 + pdf.x1
    for c, share in (("x1", 0.2), ("x2", 0.1), ("y1", 0.05), ("y2", 0.4)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    frame_ = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x1 double, x2 double, x3 double, y1 double, y2 double")
    got = {(r.g, r.factor, r.target_col): r for r in G.correlation_grid(frame_, ["g"], ["x1", "x2", "x3"], ["y1", "y2"], cuts=4).collect()}
    assert len(got) == 18
    for (g, x, y), r in got.items():
        mine = pdf[pdf.g.isna() if g is None else pdf.g == g].dropna(subset=[x, y])
        assert (r.n, r.distinct_count) == (len(mine), mine[x].nunique())
        if x == "x3":
            assert r.spearman_ic is None and r.pearson_ic is None
        else:
            np.testing.assert_allclose([r.spearman_ic, r.pearson_ic], [mine[x].rank().corr(mine[y].rank()), mine[x].corr(mine[y])], rtol=1e-9)
        np.testing.assert_allclose(r.edges, np.unique(mine[x].quantile([0, 0.25, 0.5, 0.75, 1])), rtol=1e-12)
    assert G.correlation_grid(frame_.where("g = 'none'"), ["g"], ["x1"], ["y1"]).collect() == []


def test_no_join_on_a_value(spark):
    rows = spark.createDataFrame(frame(spark))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(G.correlation_grid(rows, ["g"], ["x"], ["y"]))
    joins = [line for line in plan(RK.ranks_in_place(rows, ["g"], "x", "id", ["1"])).splitlines() if "Join" in line]
    assert len(joins) == 1 and "_slice" in joins[0] and not any(f"{c}#" in joins[0] for c in ("x", "y"))
