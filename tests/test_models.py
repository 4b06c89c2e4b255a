"""M3: fitted folds against a hand-fitted optimum and seeded runs; X5 from fitted models."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import models as M

SMALL = M.Fits(trees=20, rounds=10, forest_depth=4, depth=3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x, z, g = rng.normal(size=600), rng.normal(size=600) * 50, rng.integers(0, 3, 600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x + 0.01 * z + (g == 1))))).astype(int)
    df = spark.createDataFrame([(i, float(x[i]), float(z[i]), f"g{g[i]}", int(y[i]), i % 5) for i in range(600)], "row_id long, x double, z double, g string, y int, fold int")
    return M.prepared(df, "y", ["x", "z"], ["g"])


def logistic_optimum(a, y, n):
    """Newton steps on the summed log loss plus half the squared weights of standardised features."""
    s = a.std(0, ddof=1)
    b = np.c_[a / np.where(s > 0, s, 1), np.ones(n)]
    w, ridge = np.zeros(b.shape[1]), np.diag([1.0] * a.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-b @ w))
        w -= np.linalg.solve(b.T @ (b * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), b.T @ (p - y) + ridge @ w)
    return w[:-1] / np.where(s > 0, s, 1), w[-1]


def test_logistic_folds_reach_the_optimum(rows):
    table, names = rows
    assert names == ["x", "z", "g=g0", "g=g1", "g=g2"]
    all_rows = table.orderBy("row_id").collect()
    a, y, fold = (np.array(v) for v in zip(*[(r["features"].toArray(), r["label"], r["fold"]) for r in all_rows]))
    got = {r["row_id"]: (r["score"], r["y_pred"]) for r in M.out_of_fold(table, "fold", 5, ["LogisticRegression"]).collect()}
    assert len(got) == 600
    for k in range(5):
        w, c = logistic_optimum(a[fold != k], y[fold != k], int((fold != k).sum()))
        for i in np.flatnonzero(fold == k):
            want = 1 / (1 + np.exp(-(a[i] @ w + c)))
            assert got[i][0] == pytest.approx(want, abs=2e-3) and (got[i][1] == (want > 0.5) or abs(want - 0.5) < 2e-3)


def test_trees_are_seeded_out_of_fold_and_better_than_chance(rows):
    table, _ = rows
    run = lambda: {(r["model_id"], r["row_id"]): r["score"] for r in M.out_of_fold(table, "fold", 5, ["RandomForest", "BoostedTrees"], SMALL).collect()}
    one, two = run(), run()
    assert one.keys() == two.keys() and len(one) == 1200
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9
    y = {r["row_id"]: r["label"] for r in table.collect()}
    for m in ("RandomForest", "BoostedTrees"):
        assert np.mean([(one[m, i] > 0.5) == (y[i] == 1) for i in y]) > 0.65
    # a row's prediction doesn't move when its own fold's labels do
    flipped = table.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label")))
    other = {r["row_id"]: r["score"] for r in M.out_of_fold(flipped, "fold", 5, ["RandomForest"], SMALL).filter("fold = 2").collect()}
    assert all(abs(s - one["RandomForest", i]) < 1e-9 for i, s in other.items())


def test_native_importance_of_fitted_models(spark, rows):
    table, names = rows
    for a in M.ALGORITHMS:
        got = M.native_importance(spark, M.fit(table, a, SMALL), names).orderBy("rank").collect()
        assert sorted(r["feature"] for r in got) == sorted(names)
        assert sum(r["importance"] for r in got) == pytest.approx(1) and all(p["importance"] >= q["importance"] for p, q in zip(got, got[1:]))
        if a != "LogisticRegression":
            assert got[0]["feature"] == "x"


def test_prepared_rows_come_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_A_TASK", 50)
    monkeypatch.setattr(M, "MOST_ROWS_A_TASK", 100)
    monkeypatch.setattr(M, "USUAL_TASKS", 8)
    df = spark.range(2000).selectExpr("id", "id % 2 AS y", "id * 1.0D AS x", "CAST(id % 3 AS STRING) AS g")
    table, _ = M.prepared(df, "y", ["x"], ["g"])
    sizes = [len(p) for p in table.filter("id % 5 <> 0").rdd.glom().collect()]
    assert sum(sizes) == 1600 and max(sizes) <= 150
    assert [M.parts(n) for n in (0, 50, 51, 400, 900)] == [1, 1, 2, 8, 9]
