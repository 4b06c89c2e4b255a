"""Order statistics in the key's own type, fingerprints, and evaluation without attributes or with text labels."""
import math

from pyspark.sql import functions as F

from trustframe.operators.attribution import choose_method, linear_model, native_importance, shapley_sample
from trustframe.operators.io import fingerprint
from trustframe.operators.prep import categories
from trustframe.operators.splits import order_statistics, positional_split, stratified_split
from trustframe.plans.evaluation import classification_parts


def test_split_of_ids_beyond_double_precision(spark):
    df = spark.range(20).select((F.col("id") + F.lit(2**60)).alias("id"))
    got = positional_split(df, [], ["id"], unique_numeric_key=True).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 16, "test": 4}


def test_few_valued_column_beside_a_sparse_one(spark):
    rows = [("few", i % 10) for i in range(6000)] + [("sparse", 2**60 + 7 * i) for i in range(9)] + [("null", None)]
    df = spark.createDataFrame(rows, "c string, v long")
    for accuracy in (50, 200000):
        got = {r["c"]: (r["a"], r["b"]) for r in order_statistics(
            df, ["c"], "v", [("a", 0.25, "floor"), ("b", 0.9, "ceil")], accuracy).collect()}
        assert got == {"few": (2, 9), "sparse": (2**60 + 14, 2**60 + 56)}


def test_fingerprint_tells_rows_apart(spark):
    one = lambda rows, schema: fingerprint(spark.createDataFrame(rows, schema)).first()
    sums = lambda r: (r["checksum"], r["checksum_xor"])
    assert sums(one([(0.001,)], "a double")) != sums(one([(0.004,)], "a double"))
    assert sums(one([(None, "x")], "a string, b string")) != sums(one([("x", None)], "a string, b string"))
    assert sums(one([("a", "b|c")], "a string, b string")) != sums(one([("a|b", "c")], "a string, b string"))
    assert sums(one([(1,), (2,)], "a int")) == sums(one([(2,), (1,)], "a int"))
    big = fingerprint(spark.range(200000)).first()
    assert int(big["checksum"]) > 2**63  # a sum that a long can't hold
    assert one([], "a int")["row_count"] == 0


def test_metrics_without_attributes_and_with_text_labels(spark):
    rows = [("m", "d", "train" if i % 5 else "test", "abc"[i % 3], "abc"[i % 2], "g") for i in range(60)]
    df = spark.createDataFrame(rows, "model_id string, dataset_id string, split string, y_true string, y_pred string, s string")
    want = sum("abc"[i % 3] == "abc"[i % 2] for i in range(60)) / 60
    for attrs in ([], ["s"]):
        metrics, train, gaps = classification_parts(df, attrs)
        assert math.isclose(metrics.first()["accuracy"], want) and train.count() == 1 and gaps.count() == 0
    binary = df.withColumn("y_true", F.lit("1")).withColumn("y_pred", (F.col("y_pred") == "a").cast("int").cast("string"))
    assert classification_parts(binary, ["s"])[2].count() == 1


def test_shapley_explains_every_row_and_is_exact_on_a_linear_model(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    got = shapley_sample(df, "id", ["a", "b"], linear_model({"a": 2.0, "b": -1.0}), n_background=300, n_samples=200).toPandas()
    assert got["id"].nunique() == 300
    mean = got.groupby("feature")["contribution"].mean()
    assert abs(mean["a"]) < 0.3 and abs(mean["b"]) < 0.3  # centred on the background
    a = got[got["feature"] == "a"].set_index("id")["contribution"]
    assert max(abs(a[i] - 2 * (i % 7 - 3)) for i in range(300)) < 1.6


def test_native_importance_method_and_categories(spark):
    assert [tuple(r) for r in native_importance(spark, ["a", "b"], [1.0, -2.0]).orderBy("rank").collect()] == [("b", 1, 2.0, 1), ("a", 0, 1.0, 2)]
    assert native_importance(spark, ["a"], [1.0, 2.0]).count() == 0
    m = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)],
                              "has_linear_weights boolean, has_expression boolean, has_native boolean")
    assert [r["method"] for r in choose_method(m).collect()] == ["linear_shapley", "permutation_shapley", "native_importance", "none"]
    assert categories(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string"), "c") == ["a", "b"]


def test_stratified_split(spark):
    df = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = stratified_split(df, [], "y", "id", 0.3).filter("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 23, 1: 8}
