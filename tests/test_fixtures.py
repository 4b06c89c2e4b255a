"""Hand-computed cases of FIXTURES §3.5–3.8."""
import pytest
from pyspark.sql import functions as F

from trustframe.operators import fairness as FA
from trustframe.operators import insights as IN
from trustframe.operators.health import dataset_stats
from trustframe.operators.metrics import classification_metrics
from trustframe.operators.registry import pair_cache_id


def test_group_fairness(spark):
    rows = [("A", 1, 1), ("A", 1, 0), ("A", 0, 0), ("A", 0, 1),
            ("B", 1, 1), ("B", 1, 1), ("B", 0, 0), ("B", 0, 0),
            ("C", 1, 0), ("C", 0, 0), ("C", 0, 1), ("C", 1, 0)]
    df = spark.createDataFrame([("m", "d", g, float(y), float(p)) for g, y, p in rows],
                               "model_id string, dataset_id string, grp string, y_true double, y_pred double")
    gm = {r.grp: r for r in FA.group_metrics(df, ["grp"]).collect()}
    assert (gm["A"].tp, gm["A"].fp, gm["A"].tn, gm["A"].fn) == (1, 1, 1, 1)
    assert gm["C"].accuracy == pytest.approx(0.25)
    assert gm["C"].positive_prediction_rate == pytest.approx(0.25)
    g = FA.fairness_gaps(FA.group_metrics(df, ["grp"])).first()
    assert g.demographic_parity_difference == pytest.approx(0.25)
    assert g.equal_opportunity_difference == pytest.approx(1.0)
    assert g.equalized_odds_difference == pytest.approx(1.0)
    assert g.predictive_parity == pytest.approx(0.0)
    assert g.statistical_parity == pytest.approx(0.75)
    assert g.disparate_impact_ratio == pytest.approx(0.5)
    assert g.fairness_score_F == pytest.approx(0.75)
    assert g.overall_fairness_score == pytest.approx(1 / 3, abs=1e-6)


def test_group_fairness_matches_pairwise(spark):
    """The closed form equals the reference's all-pairs loop."""
    import itertools
    import random
    random.seed(7)
    rows = [("m", "d", random.choice("PQRST"), float(random.random() < 0.4), float(random.random() < 0.5))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "model_id string, dataset_id string, grp string, y_true double, y_pred double")
    gm = {r.grp: r for r in FA.group_metrics(df, ["grp"]).collect()}
    g = FA.fairness_gaps(FA.group_metrics(df, ["grp"])).first()
    dp = eo = eqo = 0.0
    di = 1.0
    for a, b in itertools.combinations(gm.values(), 2):
        dp = max(dp, abs(a.positive_prediction_rate - b.positive_prediction_rate))
        e = abs(a.true_positive_rate - b.true_positive_rate)
        eo = max(eo, e)
        eqo = max(eqo, max(e, abs(a.false_positive_rate - b.false_positive_rate)))
        pa, pb = a.positive_prediction_rate, b.positive_prediction_rate
        if pa > 0 and pb > 0:
            di = min(di, pa / pb, pb / pa)
    assert g.demographic_parity_difference == pytest.approx(dp)
    assert g.equal_opportunity_difference == pytest.approx(eo)
    assert g.equalized_odds_difference == pytest.approx(eqo)
    assert g.disparate_impact_ratio == pytest.approx(di)


def test_multiclass_weighted(spark):
    y = "a a a b b c".split()
    p = "a a b b c c".split()
    df = spark.createDataFrame([("m", "d", a, b) for a, b in zip(y, p)],
                               "model_id string, dataset_id string, y_true string, y_pred string")
    r = classification_metrics(df).first()
    assert r.accuracy == pytest.approx(0.666667, abs=1e-6)
    assert r.precision == pytest.approx(0.75)
    assert r.recall == pytest.approx(0.666667, abs=1e-6)
    assert r.f1_score == pytest.approx(0.677778, abs=1e-6)


SCHEMA37 = "f1 double, f2 double, s string, target int"
ROWS37 = [(1.0, 5.0, "u", 0), (1.0, 5.0, "u", 0), (2.0, 5.0, "v", 0), (3.0, 5.0, "w", 1),
          (None, 5.0, None, 1), (10.0, 5.05, "u", 0)]


def test_dataset_stats_and_quality(spark):
    df = spark.createDataFrame(ROWS37, SCHEMA37)
    st = dataset_stats(df, "d", "target").first()
    assert st.missing_values == 2
    assert st.duplicate_ratio == pytest.approx(1 / 6)
    assert st.low_variance_fraction == pytest.approx(0.5)
    assert st.skew_score == pytest.approx(0.738340, abs=1e-6)
    assert st.imbalance_ratio == pytest.approx(4 / 6)
    q = IN.data_quality(df, "d").first()
    assert (q.completeness, q.validity, q.uniqueness, q.consistency, q.overall_score) == \
        pytest.approx((91.7, 100.0, 45.8, 88.9, 81.6))
    assert q.status == "good"
    o = {r.feature: r["count"] for r in IN.outliers_iqr(df).collect()}
    assert o == {"f1": 1, "f2": 1}


def test_outliers_iqr_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double")
    r = IN.outliers_iqr(df).first()
    assert r["count"] == 1 and r.impact == "medium" and r.percentage == pytest.approx(10.0)
    assert (r.lower_bound, r.upper_bound) == pytest.approx((-3.5, 14.5))
    assert r.mean == pytest.approx(14.5) and r.std == pytest.approx(30.152391, abs=1e-6)
    q = IN.quartiles(df, ["x"]).first()
    assert (q.q1, q.q3) == pytest.approx((3.25, 7.75))


def test_correlations_with_nulls(spark):
    x = [1, 2, 2, 3, None, 5, 7]
    y = [2, 1, 10, 3, 9, None, 20]
    df = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b))
                                for a, b in zip(x, y)], "x double, y double")
    assert IN.pearson_pairs(df, 0.0).first().correlation == pytest.approx(0.8682, abs=1e-4)
    assert IN.spearman_pairs(df, 0.0).first().correlation == pytest.approx(0.6669, abs=1e-4)


def test_pair_cache_id(spark):
    m = spark.createDataFrame([("m1", "p/m.onnx", 10, "2026-01-01 00:00:00")],
                              "model_id string, file_path string, file_size long, uploaded_at string") \
        .withColumn("uploaded_at", F.to_timestamp("uploaded_at"))
    d = spark.createDataFrame([("d1", "p/d.csv", 0, "2026-01-02 00:00:00")],
                              "dataset_id string, file_path string, file_size long, uploaded_at string") \
        .withColumn("uploaded_at", F.to_timestamp("uploaded_at"))
    pairs = spark.createDataFrame([("m1", "d1")], "model_id string, dataset_id string")
    got = pair_cache_id(m, d, pairs).first().pair_cache_id
    assert got == "f97b14f201f6a1fc9ab57f871a526c5addbe5f2c93dee7a825a9665370ec80a0"
