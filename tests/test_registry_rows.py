"""Best evaluation, versions on the model row, upload checks, bands, bounded categories."""
import pytest
from pyspark.sql import functions as F

from trustframe.operators.fairness import dii_band, labelled_metrics, trust_band
from trustframe.operators.prep import categories
from trustframe.operators.registry import best_evaluation, framework_check, refresh_models, versions_from


def test_best_evaluation_prefers_the_pair_then_the_newest(spark):
    ev = spark.createDataFrame([(1, "a", 10.0, "2024-01-01"), (1, "b", 20.0, "2024-02-01"), (1, "c", 30.0, "2024-02-01"), (1, "d", 40.0, None),
                                (2, "x", 5.0, None)], "model_id long, dataset_id string, eval_score double, t string")
    ev = ev.withColumn("evaluated_at", F.to_timestamp("t")).drop("t")
    req = spark.createDataFrame([(1, "a"), (1, "a"), (1, "zz"), (1, None), (2, "a"), (3, "a")], "model_id long, dataset_id string")
    got = {(r["model_id"], r["dataset_id"]): (r["eval_dataset_id"], r["eval_score"], r["exact_match"]) for r in best_evaluation(req, ev).collect()}
    assert got == {(1, "a"): ("a", 10.0, True), (1, "zz"): ("b", 20.0, False), (1, None): ("b", 20.0, None), (2, "a"): ("x", 5.0, False)}
    assert best_evaluation(req, ev.limit(0)).count() == 0


def test_versions_number_and_refresh_the_model_row(spark):
    events = spark.createDataFrame([(1, "2024-01-02", "p2", 20), (1, "2024-01-01", "p1", 10), (1, "2024-01-02", "p3", None), (2, None, "q", 7)],
                                   "model_id long, created_at string, file_path string, file_size long")
    v = versions_from(events)
    assert {(r["model_id"], r["file_path"]): r["version"] for r in v.collect()} == {(1, "p1"): 1, (1, "p2"): 2, (1, "p3"): 3, (2, "q"): 1}
    models = spark.createDataFrame([(1, "old", 1), (2, "old", 2), (3, "old", 3)], "model_id long, file_path string, file_size long")
    got = {r["model_id"]: (r["file_path"], r["file_size"], r["n_versions"]) for r in refresh_models(models, v).collect()}
    assert got == {1: ("p3", 1, 3), 2: ("q", 7, 1), 3: ("old", 3, 0)}
    assert refresh_models(models, v.drop("file_size")).filter("model_id = 2").first()["file_size"] == 2


def test_upload_check(spark):
    df = spark.createDataFrame([("a.PKL", "sklearn"), ("a.pkl", " SKLearn "), ("a.pkl", None), ("a.onnx", "keras"), ("a.exe", None), ("a", "x"), (None, "x")],
                               "p string, d string")
    got = [r[0] for r in df.select(framework_check(F.col("p"), F.col("d"))).collect()]
    assert got == ["accepted", "accepted", "accepted", "framework_mismatch"] + ["extension_not_allowed"] * 3


def test_labels_and_bands(spark):
    g = spark.createDataFrame([("m", 0.1, 1.25, None), ("n", 0.21, 0.6, 0.8)], "id string, a_difference double, b_ratio double, score double")
    got = {(r["id"], r["metric"]): r["label"] for r in labelled_metrics(g, ["a_difference", "b_ratio", "score"]).collect()}
    assert got == {("m", "a_difference"): "good", ("m", "b_ratio"): "good", ("n", "a_difference"): "poor", ("n", "b_ratio"): "fair", ("n", "score"): "good"}
    b = spark.createDataFrame([(70.0, 0.15), (69.9, 0.3), (39.0, 0.5), (None, 0.51), (0.0, None)], "t double, d double")
    assert [tuple(r) for r in b.select(trust_band(F.col("t")), dii_band(F.col("d"))).collect()] == [
        ("High Trust", 1), ("Moderate Trust", 2), ("Low Trust", 3), (None, 4), ("Low Trust", None)]


def test_categories_are_bounded(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    assert len(categories(df, "c", 20)) == 20
    with pytest.raises(ValueError):
        categories(df, "c", 19)
