"""Sources, sinks and preparation helpers without a registered query."""
import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from trustframe.operators.fairness import fairness_level, metric_label
from trustframe.operators.io import content_hash, export, fingerprint
from trustframe.operators.prep import binarise, resolve_attribute
from trustframe.sources.tables import column_roles, read_dataset


def test_csv_na_tokens_and_roles(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-")
    path = os.path.join(d, "x.csv")
    with open(path, "w") as f:
        f.write("a,b,s,target,e\n1,2.5,NA,0,\nnan,3.0,x,1,NA\n2,,N/A,1,\n")
    df = read_dataset(spark, path).drop("e")
    assert dict(read_dataset(spark, path).dtypes)["e"] == "double"
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "s": "string", "target": "bigint"}
    rows = {(r["target"], r["b"]): r for r in df.collect()}
    assert rows[(0, 2.5)]["s"] is None and rows[(1, 3.0)]["a"] is None and rows[(1, None)]["s"] is None
    assert column_roles(df) == ("target", ["a", "b", "s"])
    assert column_roles(df, "a") == ("a", ["b", "s", "target"])


def test_content_hash_and_export_roundtrip(spark):
    src = "/root/testdata/sf0.001/region.parquet"
    got = content_hash(spark, src).first()["file_hash"]
    with open(src, "rb") as f:
        assert got == hashlib.sha256(f.read()).hexdigest()
    out = tempfile.mkdtemp(prefix="tf-exp-") + "/region_csv"
    region = spark.read.parquet(src)
    export(region, out, "csv")
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(out)
    assert back.count() == region.count()
    assert fingerprint(region).first()["row_count"] == region.count()


def test_resolve_attribute_and_labels(spark):
    df = spark.createDataFrame(
        [(["sex", "age"], "race", "sex", None), (["sex", "age"], None, None, "age"), (["x"], "y", "z", None)],
        "cols array<string>, req string, ds string, meta string")
    got = [r[0] for r in df.select(resolve_attribute(F.col("cols"), F.col("req"), F.col("ds"), F.col("meta")))
           .collect()]
    assert got == ["sex", "age", None]
    lab = spark.createDataFrame([("demographic_parity_difference", 0.15), ("disparate_impact_ratio", 0.7),
                                 ("statistical_parity", 0.9)], "m string, v double")
    assert [r[0] for r in lab.select(metric_label(F.col("m"), F.col("v"))).collect()] == ["fair", "fair", "good"]
    lv = spark.createDataFrame([(0.95,), (0.8,), (0.65,), (0.2,)], "o double")
    assert [r[0] for r in lv.select(fairness_level(F.col("o"))).collect()] == ["excellent", "good", "fair", "poor"]
    b = spark.createDataFrame([("a",), ("b",)], "g string").select(binarise(F.col("g"), "a")).collect()
    assert [r[0] for r in b] == ["a", "Other"]
