"""Predictions and dataset tables derived from the given TPC-H-style tables.

The reference scores one uploaded model on one uploaded CSV.  Here a
*predictions table* holds many (model, dataset) pairs at once:

    model_id, dataset_id, row_id, split, y_true, y_pred, <attribute columns>

Models are rules over the given columns (the reference's model loaders are
not built; see README).  Each builder is one scan of its inputs: the rules
are applied with a single ``explode`` over an array of (model_id, y_pred)
structs rather than one scan per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.operators.splits import positional_split
from trustframe.sources.tables import table

K = ["model_id", "dataset_id"]

# Rule models on the order table.
BINARY_RULES = {
    "m_price": "o_totalprice > 200000",
    "m_priority": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "m_acctbal": "c_acctbal > 5000",
}
MULTICLASS_RULES = {
    "mc_price": "CASE WHEN o_totalprice < 166800 THEN 'F' WHEN o_totalprice < 334700 THEN 'O' ELSE 'P' END",
    "mc_priority": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' "
                   "WHEN o_orderpriority = '3-MEDIUM' THEN 'O' ELSE 'P' END",
}
REGRESSION_RULES = {
    "r_qty_price": "l_quantity * p_retailprice",
    "r_damped": "0.5D * l_quantity * p_retailprice",
    "r_fit": "l_extendedprice * (0.9D + 0.01D * (l_linenumber % 20))",
}
DOC_RULES = {
    "d_len": "CASE WHEN n_chars > 1000 THEN 1.0D ELSE 0.0D END",
    "d_lang": "CASE WHEN lang = 'en' THEN 1.0D ELSE 0.0D END",
}
ORDER_ATTRS = ["c_mktsegment", "n_regionkey", "o_orderpriority"]
LINE_ATTRS = ["l_returnflag", "l_linestatus"]
DOC_ATTRS = ["lang", "source"]


def _explode_models(df: DataFrame, rules: dict[str, str], pred_type: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(m).alias("model_id"),
                             F.expr(r).cast(pred_type).alias("y_pred"))
                    for m, r in rules.items()])
    return df.withColumn("_m", F.explode(arr)).select("*", "_m.model_id", "_m.y_pred").drop("_m")


def orders_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table: orders joined to customer and nation; target last."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderpriority",
                     "c_acctbal", "c_mktsegment",
                     F.col("n_regionkey").cast("string").alias("n_regionkey"),
                     "o_orderstatus",
                     (F.col("o_orderstatus") == "F").cast("int").alias("target")))


def lineitem_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    l_ = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return (l_.join(p, l_.l_partkey == p.p_partkey)
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                      "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
                      "l_returnflag", "l_linestatus", "l_extendedprice"))


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
              "l_extendedprice", "l_quantity"]


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary classification pairs on ``orders_status``, with a positional
    80/20 split by ``row_id`` shared by the three models."""
    ds = positional_split(orders_dataset(spark, sf_dir), [], ["row_id"], unique_numeric_key=True)
    p = _explode_models(ds, BINARY_RULES, "double")
    return p.select("model_id", F.lit("orders_status").alias("dataset_id"), "row_id", "split",
                    F.col("target").cast("double").alias("y_true"), "y_pred", *ORDER_ATTRS)


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = orders_dataset(spark, sf_dir)
    p = _explode_models(ds, MULTICLASS_RULES, "string")
    return p.select("model_id", F.lit("orders_status_mc").alias("dataset_id"), "row_id",
                    F.col("o_orderstatus").alias("y_true"), "y_pred", *ORDER_ATTRS)


def multiclass_split_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text labels, with the positional 80/20 split by ``row_id``."""
    ds = positional_split(orders_dataset(spark, sf_dir), [], ["row_id"], unique_numeric_key=True)
    p = _explode_models(ds, MULTICLASS_RULES, "string")
    return p.select("model_id", F.lit("orders_status_mc").alias("dataset_id"), "row_id", "split",
                    F.col("o_orderstatus").alias("y_true"), "y_pred", *ORDER_ATTRS)


def regression_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = positional_split(lineitem_dataset(spark, sf_dir), [], LINE_ORDER)
    p = _explode_models(ds, REGRESSION_RULES, "double")
    return p.select("model_id", F.lit("lineitem_price").alias("dataset_id"), "split",
                    F.col("l_extendedprice").alias("y_true"), "y_pred", *LINE_ATTRS)


def docs_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id")


def docs_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = positional_split(docs_dataset(spark, sf_dir), [], ["doc_id"], unique_numeric_key=True)
    p = _explode_models(ds, DOC_RULES, "double")
    return p.select("model_id", F.lit("docs_quality").alias("dataset_id"),
                    F.col("doc_id").alias("row_id"), "split",
                    F.col("quality").cast("double").alias("y_true"), "y_pred", *DOC_ATTRS)


def embedding_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label per vector vs a rule on the first coordinate (10 bins)."""
    e = table(spark, sf_dir, "embeddings")
    first = F.element_at("embedding", 1).cast("double")
    pred = F.least(F.lit(9), F.greatest(F.lit(0), F.floor((first + 0.5) * 10).cast("int")))
    return e.select(F.lit("cv_bins").alias("model_id"), F.lit("embeddings").alias("dataset_id"),
                    F.col("vec_id").alias("row_id"), F.col("label").alias("y_true"),
                    pred.alias("y_pred"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn paired with the assistant turn that directly follows it
    (prediction = assistant text, reference = user text).

    Written as an equi-join on ``(conv_id, turn + 1)`` instead of a ``lead``
    window: the join key is unique per row, so one very long conversation
    does not land in one task.
    """
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", "prediction", "reference")


def attr_expr(name: str) -> Column:
    return F.col(name).cast("string")
