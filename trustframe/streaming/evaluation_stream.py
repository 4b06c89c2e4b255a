"""Streaming evaluation: predictions arrive as files; evaluations are kept current.

The stream keeps only *sufficient statistics* as state: the count per
(pair, split, attribute, group, label, prediction) — a streaming
``groupBy().count()`` whose state is bounded by pairs × groups × classes,
not by rows.  Each micro-batch (``foreachBatch``) receives the full current
summary (complete mode), re-derives metrics, fairness and trust for every
pair with the batch code path, and upserts them (S9) into the sink: version
folders ``<sink>/v=<epoch>``, each holding the whole current table, so a
re-run epoch overwrites its own folder (idempotent) and readers take the
newest complete version.

The split column must be assigned by the producer (a positional split needs
the whole table and is not defined on an unbounded stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.operators.fairness import unpivot_attrs
from trustframe.plans.evaluation import (K, assemble_inputs, classification_parts_from_summary, score)

PRED_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("row_id", T.LongType()), T.StructField("split", T.StringType()),
    T.StructField("y_true", T.DoubleType()), T.StructField("y_pred", T.DoubleType()),
])


def summary_stream(stream: DataFrame, attrs: list[str]) -> DataFrame:
    long = unpivot_attrs(stream, attrs, [*K, "split", "y_true", "y_pred"])
    return (long.groupBy(*K, "split", "attr", "attr_ord", "grp", "y_true", "y_pred")
                .agg(F.count(F.lit(1)).alias("n")))


def latest_version(spark: SparkSession, sink: str) -> DataFrame | None:
    """Newest complete version folder, listed through the Hadoop FileSystem
    (works for the shared cluster file system as well as local paths)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    vs = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            vs.append(int(name.split("=")[1]))
    return spark.read.parquet(f"{sink.rstrip('/')}/v={max(vs)}") if vs else None


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, stats: DataFrame,
          attrs: list[str], schema: T.StructType, available_now: bool = True):
    """Start the query; ``stats`` is the (static) dataset-statistics table."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    summ = summary_stream(stream, attrs)

    def upsert(batch: DataFrame, epoch: int) -> None:
        metrics, train, gaps = classification_parts_from_summary(batch)
        fresh = score(assemble_inputs(metrics, train, gaps, stats, "classification"))
        fresh = fresh.select(*K, "trust_mode", "eval_score", "trust_score", "DII", "verdict_status",
                             F.array_join("flags", ",").alias("flags"), F.lit(epoch).alias("epoch"))
        old = latest_version(batch.sparkSession, sink_dir)
        out = fresh if old is None else old.join(fresh.select(*K).distinct(), K, "left_anti").unionByName(fresh)
        out.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/v={epoch}")

    w = (summ.writeStream.outputMode("complete").foreachBatch(upsert)
             .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
