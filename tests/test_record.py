"""The full record's maps, and incremental evaluation of the pairs that a comparison lacks."""

import pytest
from pyspark.sql import functions as F

from trustframe.functions.trust import score_maps
from trustframe.plans import evaluation as E

SF = "/root/testdata/sf0.001"


def test_score_maps_hold_present_metrics(spark):
    df = spark.createDataFrame([("classification", 0.9, None, 1.5, None, None), ("regression", None, None, None, -0.2, 3.0)],
                               "model_type string, accuracy double, precision double, f1_score double, r2_score double, mae double")
    a, b = score_maps(df).orderBy("model_type").collect()
    assert a.normalized_metrics == {"accuracy": 0.9, "f1_score": 1.0}  # a missing metric is absent
    assert a.weight_distribution == {"accuracy": 0.25, "precision": 0.25, "recall": 0.25, "f1_score": 0.25}
    assert b.normalized_metrics == {"r2_score": 0.0, "mae": pytest.approx(0.25)}


def test_only_missing_pairs_are_evaluated(spark, tmp_path):
    wl = E.WORKLOADS["orders_status"]
    preds = wl.preds(spark, SF)
    path = str(tmp_path / "summaries")
    E.classification_summary(preds.filter("model_id = 'm_price'"), wl.attrs).write.parquet(path)
    wanted = preds.select(*E.K).distinct()
    # predictions of the stored pair are spoiled: they must not be read again
    spoiled = preds.withColumn("y_pred", F.when(F.col("model_id") == "m_price", 0.0).otherwise(F.col("y_pred")))
    got = E.refresh_summaries(spark, path, spoiled, wl.attrs, wanted)
    full = E.classification_summary(preds, wl.attrs)
    assert got.exceptAll(full).isEmpty() and full.exceptAll(got).isEmpty()
    n = spark.read.parquet(path).count()
    assert E.refresh_summaries(spark, path, spoiled, wl.attrs, wanted).count() == n  # nothing is added again
    one = E.refresh_summaries(spark, path, spoiled, wl.attrs, wanted.filter("model_id = 'm_price'"))
    assert [r.model_id for r in one.select("model_id").distinct().collect()] == ["m_price"]
