"""The streaming evaluation equals the batch evaluation on the same rows."""
import tempfile

from pyspark.sql import functions as F

from trustframe.plans.evaluation import WORKLOADS, evaluate_workload
from trustframe.operators.health import dataset_stats
from trustframe.sources import workloads as W
from trustframe.streaming.evaluation_stream import PRED_SCHEMA, latest_version, start

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tf-src-")
    sink = tempfile.mkdtemp(prefix="tf-sink-") + "/evals"
    ckpt = tempfile.mkdtemp(prefix="tf-ck-")
    preds = W.binary_predictions(spark, SF)
    schema = PRED_SCHEMA
    for f in ["c_mktsegment", "n_regionkey", "o_orderpriority"]:
        schema = schema.add(f, "string")
    cols = [f.name for f in schema.fields]
    half = preds.select(*cols).withColumn("_h", F.col("row_id") % 2)
    half.filter("_h = 0").drop("_h").write.parquet(src + "/part0")
    half.filter("_h = 1").drop("_h").write.parquet(src + "/part1")
    wl = WORKLOADS["orders_status"]
    stats = dataset_stats(wl.dataset(spark, SF), wl.dataset_id, wl.target)
    q = start(spark, src + "/*", sink, ckpt, stats, W.ORDER_ATTRS, schema)
    q.awaitTermination(300)
    got = {(r.model_id, r.trust_mode): r.trust_score for r in latest_version(spark, sink).collect()}
    want = {(r.model_id, r.trust_mode): r.trust_score
            for r in evaluate_workload(spark, SF, "orders_status").collect()}
    assert got == want and len(got) == 6
