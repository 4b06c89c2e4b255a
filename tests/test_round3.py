"""Global ranks, composite-key splits and statistics of many datasets against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from trustframe.operators.health import Dataset, dataset_stats, many_dataset_stats
from trustframe.operators.splits import global_rank, positional_split


@pytest.mark.parametrize("kind", ["spread", "ties", "big", "floats", "one"])
def test_global_rank_narrows_brackets(spark, kind):
    rnd = random.Random(7)
    xs = {"spread": [rnd.randrange(10 ** 6) for _ in range(3000)],
          "ties": [rnd.choice([1, 1, 1, 5, 9]) for _ in range(2000)] + list(range(100)),
          "big": [2 ** 62 + i for i in range(2000)],  # equal as doubles
          "floats": [rnd.gauss(0, 1) for _ in range(2000)],
          "one": [4] * 500}[kind]
    t = "double" if kind == "floats" else "long"
    df = spark.createDataFrame([(x,) for x in xs], f"x {t}")
    for q in (0.0, 0.37, 0.8):
        n, k, v, below, ties = global_rank(df, F.col("x"), lambda n: int(n * q), accuracy=60)
        assert (n, k, v) == (len(xs), int(len(xs) * q), sorted(xs)[int(len(xs) * q)])
        assert below == sum(x < v for x in xs) and ties == xs.count(v)


def test_global_rank_null_or_empty(spark):
    assert global_rank(spark.createDataFrame([(1,), (None,)], "x long"), F.col("x"), lambda n: 0) is None
    assert global_rank(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), F.col("x"), lambda n: 0) is None
    n, k, v, below, ties = global_rank(spark.createDataFrame([], "x long"), F.col("x"), lambda n: 0)
    assert (n, v) == (0, None)


def _train(df, order, fraction=0.8):
    got = positional_split(df, [], order, fraction)
    return sorted(r.id for r in got.filter(F.col("split") == "train").collect())


def test_composite_split_equals_positions(spark):
    rows = [(i, (i * 7) % 4 if i % 3 else 2, None if i % 11 == 0 else f"s{(i * 5) % 6}", float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a int, b string, c double")
    order = sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3], r[0]))
    for fraction in (0.0, 0.5, 0.8, 1.0):
        assert _train(df, ["a", "b", "c", "id"], fraction) == sorted(r[0] for r in order[:int(400 * fraction)])


def test_split_without_usable_keys(spark):
    df = spark.createDataFrame([(i, None if i < 10 else i % 5) for i in range(50)], "id long, a int")
    assert len(_train(df, ["a", "id"])) == 40  # a null leading key: positions
    same = spark.createDataFrame([(i, 1) for i in range(50)], "id long, a int")
    assert len(_train(same, ["a"])) == 40  # equal keys on both sides of the cut
    text = spark.createDataFrame([(i, f"{i:03d}") for i in range(50)], "id long, a string")
    assert _train(text, ["a"]) == list(range(40))
    assert _train(spark.createDataFrame([], "id long, a int"), ["a", "id"]) == []


def test_many_datasets_in_one_call(spark):
    rows = [(0.0, "u", 1), (-0.0, "u", 1), (2.0, None, 0), (2.0, None, 0), (None, "2.0", 0), (7.5, "w", None)]
    a = spark.createDataFrame(rows, "x double, s string, y int")
    b = spark.createDataFrame([(d, i) for i, d in enumerate([3, 3, 4, 5])], "k long, z int")
    empty = spark.createDataFrame([], "x double, s string, y int")
    got = {r.dataset_id: r for r in many_dataset_stats([Dataset(a, "a", "y"), Dataset(b, "b", "z", model_type="regression"),
                                                        Dataset(empty, "e", "y")]).collect()}
    assert (got["a"].n_rows, got["a"].missing_values) == (6, 4)
    assert got["a"].duplicate_ratio == pytest.approx(2 / 6)  # 0.0 and -0.0 are equal, null and "2.0" aren't
    assert got["a"].imbalance_ratio == pytest.approx(3 / 6)
    assert (got["b"].n_features, got["b"].duplicate_ratio, got["b"].imbalance_ratio) == (1, 0.0, 0.5)
    assert (got["e"].n_rows, got["e"].missing_values, got["e"].duplicate_ratio, got["e"].skew_score) == (0, 0, 0.0, 1.0)
    assert got["a"] == dataset_stats(a, "a", "y").first()
    with pytest.raises(ValueError):
        many_dataset_stats([Dataset(a, "a", "y"), Dataset(b, "a", "z")])


def test_fingerprint_collisions_change_nothing(spark, monkeypatch):
    from trustframe.operators import health
    df = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q"), (3, "r"), (3, "r"), (3, "r")], "x int, y string")
    monkeypatch.setattr(health, "fingerprint_columns", lambda d: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    assert dataset_stats(df, "d", "y").first().duplicate_ratio == pytest.approx(3 / 6)


def test_tests_on_constant_folds(spark):
    from trustframe.plans.experiment import balanced_vs_strict, correlation_p
    rows = [(m, k, x, y, z) for m, v in (("same", lambda k: (0.75, 60.0 + k, 50.0)), ("gap", lambda k: (0.5 + k / 10, 70.0, 60.0)),
                                         ("line", lambda k: (0.5 + k / 8, 40.0 + 8 * k, 40.0 + 8 * k))) for k in range(5) for x, y, z in [v(k)]]
    folds = spark.createDataFrame(rows, "model_id string, fold int, accuracy double, trust_balanced double, trust_strict double")
    r = {x.model_id: x for x in correlation_p(folds, "accuracy", "trust_balanced", ["model_id"]).collect()}
    assert (r["same"].r, r["same"].p_value, r["gap"].r) == (None, None, None)
    assert r["line"].r == pytest.approx(1.0) and r["line"].p_value == pytest.approx(0.0, abs=1e-9)
    t = {x.model_id: x for x in balanced_vs_strict(folds).collect()}
    assert (t["gap"].t_stat, t["gap"].p_value, t["gap"].significance) == (float("inf"), 0.0, "***")
    assert (t["line"].t_stat, t["line"].p_value, t["line"].significance) == (None, None, "ns")
    assert t["same"].t_stat == pytest.approx(12.0 / (2.5 ** 0.5 / 5 ** 0.5))


def test_scenario_datasets_are_read_not_made_again(spark):
    from trustframe.plans.experiment import scenario_datasets, scenario_predictions
    made = scenario_datasets(spark, "/root/testdata/sf0.001")
    for d in made.values():
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "md5" not in plan
    p = scenario_predictions(made, "BUILDING")
    assert "md5" not in p._jdf.queryExecution().analyzed().toString().split("Generate explode")[0]  # a draw a row, below the models
    n = {k: d.count() for k, d in made.items()}
    got = {r.dataset_id: r["count"] for r in p.groupBy("dataset_id").count().collect()}
    assert got == {**{k: 3 * v for k, v in n.items()}, "strong": 3 * n["clean"], "extreme": 3 * n["clean"]}
