"""Trust scorer against the hand-computed cases of FIXTURES §3.1–3.4."""
import pytest
from pyspark.sql import functions as F

from trustframe.functions.trust import eval_score_columns, trust_columns

SCEN = {
    "Clean": dict(accuracy=0.92, f1_score=0.90, n_rows=5000, n_features=15, missing_values=10,
                  imbalance_ratio=0.55, duplicate_ratio=0.01, skew_score=0.05, dp=0.05),
    "Moderate": dict(accuracy=0.85, f1_score=0.82, n_rows=1000, n_features=20, missing_values=150,
                     imbalance_ratio=0.75, duplicate_ratio=0.10, skew_score=0.40, dp=0.25),
    "Severe": dict(accuracy=0.75, f1_score=0.70, n_rows=500, n_features=50, missing_values=300,
                   imbalance_ratio=0.92, duplicate_ratio=0.25, skew_score=0.75, dp=0.50),
}
EXPECT = {  # (mode, DII, trust, guard)
    ("Clean", "balanced"): (0.0395, 93.97, False), ("Clean", "strict"): (0.1537, 88.87, False),
    ("Moderate", "balanced"): (0.2326, 81.19, False), ("Moderate", "strict"): (0.7320, 46.58, True),
    ("Severe", "balanced"): (0.4187, 64.27, False), ("Severe", "strict"): (0.9704, 25.37, True),
}
SCHEMA = ("name string, trust_mode string, model_type string, accuracy double, f1_score double, "
          "precision double, recall double, r2_score double, mse double, mae double, rmse double, "
          "n_rows long, n_features long, missing_values long, imbalance_ratio double, "
          "duplicate_ratio double, skew_score double, low_variance_fraction double, "
          "fairness_evaluated boolean, dp double, has_train boolean")


def _row(name, mode, mtype="classification", fe=True, **kw):
    keys = ["accuracy", "f1_score", "precision", "recall", "r2_score", "mse", "mae", "rmse",
            "n_rows", "n_features", "missing_values", "imbalance_ratio", "duplicate_ratio",
            "skew_score", "low_variance_fraction"]
    return (name, mode, mtype, *[kw.get(k) for k in keys], fe, kw.get("dp"), False)


def test_three_scenarios(spark):
    rows = [_row(n, m, **v) for n, v in SCEN.items() for m in ("balanced", "strict")]
    out = trust_columns(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in out:
        dii, trust, guard = EXPECT[(r["name"], r["trust_mode"])]
        assert r["DII"] == pytest.approx(dii, abs=1e-4)
        assert r["trust_score"] == pytest.approx(trust, abs=0.011)
        assert r["guard_triggered"] == guard
        s = r["beta_performance"] + r["beta_health"] + r["beta_fairness"] + r["beta_robustness"]
        assert s == pytest.approx(1.0, abs=1e-9)
    sev = [r for r in out if r["name"] == "Severe" and r["trust_mode"] == "strict"][0]
    assert sev["verdict_status"] == "high_risk"
    assert sev["lambda_value"] == pytest.approx(0.85)


def test_other_cases(spark):
    rows = [
        _row("dii", "balanced", fe=False, accuracy=0.85, precision=0.82, recall=0.88, f1_score=0.85,
             n_rows=1000, n_features=10, missing_values=50, imbalance_ratio=0.7,
             duplicate_ratio=0.05, skew_score=0.3, low_variance_fraction=0.1),
        _row("reg", "balanced", mtype="regression", fe=False, mse=0.01, rmse=0.1, mae=0.08,
             r2_score=0.92, n_rows=1000, n_features=10, missing_values=5, duplicate_ratio=0.01,
             skew_score=0.2),
        _row("poor", "balanced", fe=False, accuracy=0.1, precision=0.1, recall=0.1, f1_score=0.1,
             n_rows=50, n_features=100, missing_values=25, imbalance_ratio=0.98,
             duplicate_ratio=0.5, skew_score=0.9, low_variance_fraction=0.8),
    ]
    out = {r["name"]: r for r in trust_columns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["dii"]["DII"] == pytest.approx(0.1767, abs=1.1e-4)
    assert out["dii"]["delta"] == pytest.approx(0.03)
    assert out["dii"]["trust_score"] == pytest.approx(86.39, abs=0.011)
    assert out["reg"]["DII"] == pytest.approx(0.0322, abs=1e-4)
    assert out["reg"]["trust_score"] == pytest.approx(94.71, abs=0.011)
    assert out["poor"]["DII"] == pytest.approx(0.5247, abs=1e-4)
    assert out["poor"]["trust_score"] == pytest.approx(34.07, abs=0.011)
    assert out["poor"]["verdict_status"] == "high_risk"
    assert [f["component"] for f in out["poor"]["guard_failures"]] == ["performance"]
    assert "fairness_unverified" in out["poor"]["flags"]
    assert out["poor"]["recommendations"][0]["priority"] == "critical"


def test_eval_score(spark):
    df = spark.createDataFrame(
        [("classification", 0.92, 0.89, 0.87, 0.88, None, None, None, None, None)],
        "model_type string, accuracy double, precision double, recall double, f1_score double, "
        "mae double, rmse double, r2_score double, std_y double, range_y double")
    assert eval_score_columns(df).first()["eval_score"] == pytest.approx(89.0)
    df2 = spark.createDataFrame(
        [("regression", None, None, None, None, 0.15, 0.22, None, None, None)], df.schema)
    assert eval_score_columns(df2).first()["eval_score"] == pytest.approx(50.68)
