"""Fitted models in full: every round, in bounded tasks over counted cells; Shapley values without interpreted samples."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trustframe.operators import attribution as A
from trustframe.operators import counted as C
from trustframe.operators import models as M
from trustframe.plans import experiment as X


@pytest.fixture(scope="module")
def orders_at(spark, tmp_path_factory):
    """A folder with the tables of the order dataset: 400 orders of 40 customers."""
    at = str(tmp_path_factory.mktemp("orders"))
    spark.range(400).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "element_at(array('F', 'O', 'P'), CAST(id * 7 % 3 AS INT) + 1) AS o_orderstatus",
                                "1000D + id * 37 % 401 AS o_totalprice", "concat(id % 5, '-P') AS o_orderpriority").write.parquet(f"{at}/orders.parquet")
    spark.range(40).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey", "id * 11 % 41 - 5D AS c_acctbal",
                               "concat('S', id % 3) AS c_mktsegment").write.parquet(f"{at}/customer.parquet")
    spark.range(5).selectExpr("CAST(id AS INT) AS n_nationkey", "CAST(id % 2 AS INT) AS n_regionkey").write.parquet(f"{at}/nation.parquet")
    return at


def test_fitted_predictions_ask_for_all_rounds(spark, orders_at, monkeypatch):
    asked = []

    def seen(rows, fold, folds, algorithms=M.ALGORITHMS, fits=M.Fits(), **kw):
        asked.append((sorted(algorithms), fits))
        return rows.select(F.lit("LogisticRegression").alias("model_id"), *[c for c in rows.columns if c not in ("label", "features")],
                           F.lit(0.0).alias("y_pred"), F.lit(0.0).alias("score"))

    monkeypatch.setattr(M, "out_of_fold", seen)
    monkeypatch.setattr(X, "_FITTED", {})
    assert X.fitted_predictions(spark, orders_at).count() == 400
    (algorithms, fits), = asked
    assert algorithms == sorted(M.ALGORITHMS) and fits == M.Fits()
    assert (fits.trees, fits.rounds, fits.depth, fits.rate) == (200, 200, 5, 0.1)


def made_rows(spark, n=800):
    rng = np.random.default_rng(11)
    x, z, g = rng.normal(size=n), np.round(rng.normal(size=n) * 30), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x + 0.02 * z + (g == 1) + np.sin(3 * x))))).astype(int)
    return spark.createDataFrame([(i, float(x[i]), float(z[i]), f"g{g[i]}", int(y[i]), i % 3) for i in range(n)],
                                 "row_id long, x double, z double, g string, y int, fold int")


@pytest.fixture(scope="module")
def table(spark):
    return M.prepared(made_rows(spark), "y", ["x", "z"], ["g"])[0]


def test_jobs_do_not_grow_with_rounds_and_trees(spark, table):
    sc, asked = spark.sparkContext, []
    for rounds in (2, 8):
        sc.setJobGroup(f"rounds {rounds}", "")
        fits = M.Fits(trees=rounds, rounds=rounds, depth=3, forest_depth=3)
        assert M.out_of_fold(table, "fold", 3, fits=fits).count() == 2400
        asked.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert asked[1] <= asked[0] < 60


def test_boosting_over_cells_is_boosting_over_rows(spark, table):
    fits = M.Fits(rounds=5, depth=4)
    got = {r["row_id"]: (r["score"], r["y_pred"]) for r in M.out_of_fold(table, "fold", 3, ["BoostedTrees"], fits).filter("fold = 1").collect()}
    model = M.fit(table.filter("fold <> 1"), "BoostedTrees", fits)
    rows = model.transform(table.filter("fold = 1")).select("row_id", F.element_at(vector_to_array("probability"), 2).alias("s"), "prediction").collect()
    off = np.array([abs(got[r["row_id"]][0] - r["s"]) for r in rows])
    assert len(got) == len(rows) == 267 and (off < 1e-9).mean() > 0.98 and off.max() < 0.1  # a tie may fall to another split
    assert np.mean([got[r["row_id"]][1] == r["prediction"] for r in rows]) > 0.98


def test_bins_cells_and_trees():
    assert list(C.cuts(np.array([1.0, 3.0, 3.0, 9.0]), np.ones(4))) == [2.0, 6.0] and len(C.cuts(np.array([4.0]), np.ones(1))) == 0
    x = np.random.default_rng(3).normal(size=50_000)
    u, n = C.few_points(x)
    t = C.cuts(u, n)
    assert len(u) == C.POINTS and n.sum() == len(x) and len(t) == 31
    assert np.abs(np.bincount(np.searchsorted(t, x)) / len(x) - 1 / 32).max() < 2 / C.POINTS
    ts = [t, np.array([0.5]), np.array([]), np.array([1.5, 2.5])]
    rows = np.column_stack([x[:500], np.arange(500) % 2, np.zeros(500), np.arange(500) % 4])
    codes = C.cell_codes(C.cell_keys(rows, ts), ts)
    assert all((codes[f] == np.searchsorted(ts[f], rows[:, f])).all() for f in range(4))
    # two features, the wide one first: one split each, then nothing is left to gain
    cells = C.Cells(np.array([[0, 1, 2, 0, 1, 2], [0, 0, 0, 1, 1, 1]], np.uint8), [3, 2])
    w, s = np.array([2.0, 1, 4, 3, 1, 2]), np.array([0.0, 0, 4, 3, 1, 2])
    tree, fitted = C.grow(cells, w, s, 5)
    np.testing.assert_allclose(fitted, s / w)
    np.testing.assert_allclose(C.at_leaves(tree, cells.codes), s / w)
    assert (C.merged(tree)[0] >= 0).sum() == 2  # pure leaves of different classes stay
    monkey = C.Cells.__new__(C.Cells)
    monkey.__dict__ = dict(cells.__dict__, two=[], pattern=None, wide=[*cells.wide, (1, cells.codes[1].astype(np.int64), 2)])
    assert all((a == b).all() for a, b in zip(C.grow(monkey, w, s, 5)[0], tree))


def test_rows_that_cannot_be_counted(spark, table, monkeypatch):
    fits = M.Fits(trees=2, rounds=2, depth=2, forest_depth=2)
    three = table.withColumn("label", F.col("row_id") % 3 * F.lit(1.0))
    assert C.out_of_fold_scores(three, "fold", 3, ["RandomForest"], fits) is None
    with pytest.raises(ValueError, match="NaN"):
        bad = M.prepared(made_rows(spark, 60).withColumn("z", F.when(F.col("row_id") != 7, F.col("z"))), "y", ["x", "z"], ["g"])[0]
        M.out_of_fold(bad, "fold", 3, ["BoostedTrees"], fits)
    monkeypatch.setattr(C, "MOST_CELLS", 10)
    assert C.out_of_fold_scores(table, "fold", 3, ["BoostedTrees"], fits) is None
    assert M.out_of_fold(table, "fold", 3, ["BoostedTrees"], fits).count() == 800  # on the rows


def test_one_label_and_equal_columns(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 2 else 2.0, 5.0, "a", int(i % 3 == 0 and i % 4 == 1), i % 3) for i in range(90)],
                               "row_id long, x double, z double, g string, y int, fold int")
    table = M.prepared(df, "y", ["x", "z"], ["g"])[0]
    got = M.out_of_fold(table, "fold", 3, fits=M.Fits(trees=3, rounds=3)).collect()
    # without fold 0 all labels are 0
    assert len(got) == 270 and all(r["y_pred"] == 0 and r["score"] < 1e-3 for r in got if r["fold"] == 0 and r["model_id"] != "BoostedTrees")
    assert all(0 <= r["score"] <= 1 for r in got)


def test_training_parts_count_equal_rows(spark):
    rows = [(i, float(i % 4), f"p{i % 2}", None if i % 5 == 0 else 1.0, "m", "r", i % 2 if i < 30 else 1, i * 7 % 3 if i != 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, o_totalprice double, o_orderpriority string, c_acctbal double, c_mktsegment string, n_regionkey string, target int, fold int")
    got = {r["fold"]: r for r in X.train_fold_stats(df, 3).collect()}
    for k in range(3):
        part = [r for r in rows if r[7] is not None and r[7] != k]
        ones = sum(r[6] for r in part)
        assert got[k]["n_rows"] == len(part) and got[k]["duplicate_ratio"] == pytest.approx(1 - len({r[1:6] for r in part}) / len(part))
        assert got[k]["imbalance_ratio"] == pytest.approx(min(ones, len(part) - ones) / max(ones, len(part) - ones))


def _rule(x):
    return F.when((x["a"] > 20.0) & (x["b"] > 50.0), 1.0).otherwise(0.0)


def test_shapley_values_of_a_rule_are_compiled_and_exact(spark):
    rows = [(i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(4)
    wide = A.shapley_wide(df, "id", ["a", "b"], _rule, 50, 100)
    assert "aggregate(" not in wide._jdf.queryExecution().optimizedPlan().toString()  # no samples gone through by lambdas
    bg = np.array([list(b) for b in A.background_rows(df, "id", ["a", "b"], 50).first()["background"]])
    plan = A.sample_plan(2, 100)
    js = [int(share * 50) for share, _ in plan]  # the background row of each sample
    rule = lambda a, b: float(a > 20 and b > 50)
    base = np.mean([rule(*b) for b in bg])
    got = wide.collect()
    assert len(got) == 3000
    for r in got:
        a = b = 0.0
        for j, (_, place) in zip(js, plan):
            none, both = rule(*bg[j]), rule(r["a"], r["b"])
            one = rule(r["a"], bg[j][1]) if place[0] == 0 else rule(bg[j][0], r["b"])
            a, b = (a + one - none, b + both - one) if place[0] == 0 else (a + both - one, b + one - none)
        np.testing.assert_allclose(r["contributions"], [a / 100, b / 100], atol=1e-12)
        assert r["base_value"] == pytest.approx(base) and r["prediction"] == rule(r["a"], r["b"])


def test_shapley_values_compiled_and_by_lambdas_agree(spark, monkeypatch):
    rows = [(i if i != 9 else None, float(i % 7) if i % 8 else None, float(i * 5 % 11), float("nan") if i == 5 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "id long, a double, b double, c double")
    model = lambda x: F.coalesce(x["a"], F.lit(2.0)) * x["b"] + F.when(x["c"] > 1.0, x["a"]).otherwise(0.5)
    for n_background, n_samples in ((12, 30), (100, 7)):
        run = lambda: sorted(map(str, A.shapley_wide(df, "id", ["a", "b", "c"], model, n_background, n_samples).select(
            "id", "a", "b", "c", F.round("prediction", 9), F.round("base_value", 9), F.transform("contributions", lambda x: F.round(x, 9) + 0.0)).collect()))
        one = run()
        monkeypatch.setattr(A, "MOST_MIXES", -1)
        two = run()
        monkeypatch.undo()
        assert one == two and len(one) == 65
    assert A.shapley_wide(df.limit(0), "id", ["a", "b", "c"], model).collect() == []
