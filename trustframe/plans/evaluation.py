"""T25 + §3.1: the full evaluation record for many (model, dataset) pairs.

Plan (one scan of the predictions table):

  predictions ─explode(attr)─► partial agg by (pair, split, attr, grp, y, ŷ) ─┬─► all-rows metrics (A1/A3)
                                                                            ├─► train-split metrics (δ)
                                                                            └─► test-split group table (A5–A9)
  dataset table ─► statistics (A11) ──────────────────────────────────────────┐
  join on pair / dataset_id ─► EvalScore (T1) ─► explode(mode) ─► trust (T2–T16)

The summary aggregate is referenced three times; it is materialised once
with ``checkpoint()`` (it has one row per pair × split × attribute × group ×
class pair), so the predictions are read and shuffled once.  Everything after it works on
tables with one row per (pair, class pair, group).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions.expr import lit_d, round_half
from trustframe.functions.trust import eval_score_columns, score_maps, trust_columns, with_gap_warning
from trustframe.operators.fairness import (detect_sensitive_attributes, fairness_gaps, fairness_summary,
                                           group_metrics_from_counts, regression_fairness,
                                           unpivot_attrs)
from trustframe.operators.health import dataset_stats
from trustframe.operators.metrics import metrics_from_confusion
from trustframe.session import checkpoint_dir
from trustframe.sources import workloads as W

K = ["model_id", "dataset_id"]
MODES = ("balanced", "strict")


@dataclass
class Workload:
    preds: Callable[[SparkSession, str], DataFrame]
    dataset: Callable[[SparkSession, str], DataFrame]
    dataset_id: str
    target: str
    model_type: str
    attrs: list[str] | None = field(default_factory=list)  # None: detected from the dataset


WORKLOADS = {
    "orders_status": Workload(
        W.binary_predictions,
        lambda s, d: W.orders_dataset(s, d).select("o_totalprice", "o_orderpriority", "c_acctbal",
                                                   "c_mktsegment", "n_regionkey", "target"),
        "orders_status", "target", "classification", W.ORDER_ATTRS),
    "orders_no_attributes": Workload(
        W.binary_predictions,
        lambda s, d: W.orders_dataset(s, d).select("o_totalprice", "o_orderpriority", "c_acctbal",
                                                   "c_mktsegment", "n_regionkey", "target"),
        "orders_status", "target", "classification", []),
    "orders_auto_attributes": Workload(
        W.binary_predictions,
        lambda s, d: W.orders_dataset(s, d).select("o_totalprice", "o_orderpriority", "c_acctbal",
                                                   "c_mktsegment", "n_regionkey", "target"),
        "orders_status", "target", "classification", None),
    "orders_multiclass": Workload(
        W.multiclass_split_predictions,
        lambda s, d: W.orders_dataset(s, d).select("o_totalprice", "o_orderpriority", "c_acctbal",
                                                   "c_mktsegment", "n_regionkey", "o_orderstatus"),
        "orders_status_mc", "o_orderstatus", "classification", W.ORDER_ATTRS),
    "lineitem_price": Workload(
        W.regression_predictions,
        lambda s, d: W.lineitem_dataset(s, d).select("l_quantity", "l_discount", "l_tax", "p_size",
                                                     "p_retailprice", "l_returnflag",
                                                     "l_linestatus", "l_extendedprice"),
        "lineitem_price", "l_extendedprice", "regression", W.LINE_ATTRS),
    "docs_quality": Workload(
        W.docs_predictions,
        lambda s, d: W.docs_dataset(s, d).select("n_chars", "lang", "source", "quality"),
        "docs_quality", "quality", "classification", W.DOC_ATTRS),
}


# ------------------------------------------------------------- classification

def classification_summary(preds: DataFrame, attrs: list[str]) -> DataFrame:
    long = unpivot_attrs(preds, attrs, [*K, "split", "y_true", "y_pred"])
    return (long.groupBy(*K, "split", "attr", "attr_ord", "grp", "y_true", "y_pred")
                .agg(F.count(F.lit(1)).alias("n")))


def _conf(summary: DataFrame, split: str | None) -> DataFrame:
    s = summary.filter(F.col("attr_ord") == 0)
    if split is not None:
        s = s.filter(F.col("split") == split)
    return s.groupBy(*K, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def _test_group_counts(summary: DataFrame, positive: float = 1.0) -> DataFrame:
    # fairness rates need 0/1 labels: a pair with others is evaluated without them
    num = (lambda c: F.expr(f"try_cast({c} AS double)"))
    other = F.coalesce(~num("y_true").isin(0.0, 1.0) | ~num("y_pred").isin(0.0, 1.0), F.lit(True))
    test = summary.filter((F.col("split") == "test") & F.col("attr").isNotNull())
    test = test.join(test.filter(other).select(*K).distinct(), K, "left_anti")
    t, p = num("y_true") == positive, num("y_pred") == positive
    n = F.col("n")
    w = (lambda c: F.sum(F.when(c, n).otherwise(0)).cast("long"))
    return (test.groupBy(*K, "attr", "attr_ord", "grp")
                   .agg(F.sum(n).cast("long").alias("n"), w(t & p).alias("tp"), w(~t & p).alias("fp"),
                        w(~t & ~p).alias("tn"), w(t & ~p).alias("fn"),
                        w(F.col("y_true") == F.col("y_pred")).alias("correct")))


def _materialise(df: DataFrame) -> DataFrame:
    """Write the (small) sufficient-statistics summary once to the shared
    checkpoint folder so its three consumers read it instead of re-running
    the scan and shuffle of the predictions."""
    checkpoint_dir(df.sparkSession)
    # persisted first so the checkpoint's write job reads the cache instead
    # of recomputing the plan (the table is small by construction)
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def classification_parts(preds: DataFrame, attrs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    return classification_parts_from_summary(_materialise(classification_summary(preds, attrs)))


def classification_parts_from_summary(summary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All-rows metrics, train metrics and test-split fairness gaps from the
    (pair, split, attr, grp, y, ŷ, n) summary — also the streaming state."""
    metrics = metrics_from_confusion(_conf(summary, None))
    train = metrics_from_confusion(_conf(summary, "train")).select(
        *K, F.col("accuracy").alias("train_accuracy"), F.col("f1_score").alias("train_f1_score"),
        F.col("precision").alias("train_precision"), F.col("recall").alias("train_recall"))
    gaps = fairness_gaps(group_metrics_from_counts(_test_group_counts(summary)))
    return metrics, train, gaps


# ----------------------------------------------------------------- regression

def regression_summary(preds: DataFrame, attrs: list[str]) -> DataFrame:
    long = unpivot_attrs(preds, attrs, [*K, "split", "y_true", "y_pred"])
    e = F.col("y_pred") - F.col("y_true")
    return (long.groupBy(*K, "split", "attr", "attr_ord", "grp")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("sae"),
                     F.sum(e * e).alias("sse"), F.sum("y_true").alias("sy"),
                     F.sum(F.col("y_true") * F.col("y_true")).alias("syy"),
                     F.sum("y_pred").alias("sp"), F.min("y_true").alias("ymin"),
                     F.max("y_true").alias("ymax"), F.min("y_pred").alias("pmin"),
                     F.max("y_pred").alias("pmax")))


def _reg_metrics(summary: DataFrame, split: str | None) -> DataFrame:
    s = summary.filter(F.col("attr_ord") == 0)
    if split is not None:
        s = s.filter(F.col("split") == split)
    a = s.groupBy(*K).agg(*[F.sum(c).alias(c) for c in ("n", "sae", "sse", "sy", "syy")],
                          F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    n = F.col("n").cast("double")
    sstot = F.greatest(lit_d(0.0), F.col("syy") - F.col("sy") * F.col("sy") / n)
    r2 = (F.when(sstot > 0, 1 - F.col("sse") / sstot)
           .when(F.col("sse") == 0, lit_d(1.0)).otherwise(lit_d(0.0)))
    return a.select(*K, F.col("n").alias("n_rows"), (F.col("sae") / n).alias("mae"),
                    (F.col("sse") / n).alias("mse"), F.sqrt(F.col("sse") / n).alias("rmse"),
                    r2.alias("r2_score"), F.sqrt(sstot / n).alias("std_y"),
                    (F.col("ymax") - F.col("ymin")).alias("range_y"))


def regression_parts(preds: DataFrame, attrs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    summary = _materialise(regression_summary(preds, attrs))
    metrics = _reg_metrics(summary, None)
    train = _reg_metrics(summary, "train").select(
        *K, F.col("r2_score").alias("train_r2_score"), F.col("mae").alias("train_mae"),
        F.col("mse").alias("train_mse"))
    test = summary.filter((F.col("split") == "test") & F.col("attr").isNotNull())
    n = F.col("n").cast("double")
    gs = test.select(*K, "attr", "attr_ord", "grp", F.col("n").alias("sample_count"),
                     (F.col("sp") / n).alias("mean_prediction"), (F.col("sy") / n).alias("mean_actual"),
                     (F.col("sae") / n).alias("mae"), F.sqrt(F.col("sse") / n).alias("rmse"),
                     F.col("pmin").alias("_min_pred"), F.col("pmax").alias("_max_pred"))
    return metrics, train, regression_fairness(gs)


# ---------------------------------------------------------------- assembly

def evaluation_inputs(spark: SparkSession, sf_dir: str, wl: Workload) -> DataFrame:
    """One row per pair: metrics, train metrics, fairness result, statistics."""
    preds, dataset = wl.preds(spark, sf_dir), wl.dataset(spark, sf_dir)
    attrs = wl.attrs
    if attrs is None:  # a list of columns: as long as the schema at most
        found = detect_sensitive_attributes(dataset, [wl.target], wl.dataset_id).orderBy("ordinal").collect()
        attrs = [r["column"] for r in found]
    parts = classification_parts if wl.model_type == "classification" else regression_parts
    metrics, train, gaps = parts(preds, attrs)
    stats = dataset_stats(dataset, wl.dataset_id, wl.target, model_type=wl.model_type)
    return assemble_inputs(metrics, train, gaps, stats, wl.model_type)


def assemble_inputs(metrics: DataFrame, train: DataFrame, gaps: DataFrame, stats: DataFrame,
                    model_type: str) -> DataFrame:
    fair = fairness_summary(gaps)
    return (metrics.withColumnRenamed("n_rows", "n_predictions")
                   .join(train, K, "left")
                   .withColumn("has_train", F.lit(True))
                   .join(fair, K, "left")
                   .join(stats, "dataset_id", "left")
                   .withColumn("model_type", F.lit(model_type))
                   .withColumn("fairness_evaluated",
                               F.coalesce(F.col("fairness_evaluated"), F.lit(False))))


def score(inputs: DataFrame, modes: tuple[str, ...] = MODES, gap_warning: bool = True) -> DataFrame:
    """T1 + T16: EvalScore, then one row per trust mode (explode, no join)."""
    scored = eval_score_columns(inputs)
    long = scored.withColumn("trust_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    out = trust_columns(long)
    if gap_warning:
        # Q6: only the balanced result receives the gap warning, as on the sync path
        out = with_gap_warning(out, only_mode="balanced")
    # The scored table is small (pairs × modes) but its columns are deep
    # expression chains; materialising it keeps later filters from being
    # pushed through (and inlined into) the whole chain by the optimizer.
    return _materialise(out)


def evaluate_workload(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return score(evaluation_inputs(spark, sf_dir, WORKLOADS[name]))


def full_record(scored: DataFrame) -> DataFrame:
    """One row a pair, as it is stored: metrics, normalised metrics and weights as maps, the balanced
    result's components, risks, weights, guard and penalty as structs, and the strict result beside it."""
    s = score_maps(scored)
    names = ("performance", "health", "fairness", "robustness")
    struct = (lambda cols: F.struct(*[F.col(c).alias(n) for n, c in zip(names, cols)]))
    metric = [m for m in ("accuracy", "precision", "recall", "f1_score", "mae", "mse", "rmse", "r2_score") if m in scored.columns]
    result = F.struct(
        "trust_score", "trust_score_raw", "DII", struct(("P", "H", "F", "R")).alias("component_scores"),
        F.struct(*[F.col(f"dii_{k}").alias(k) for k in "IMDS"]).alias("dii_components"),
        struct(("r_P", "r_H", "r_F", "r_R")).alias("risk_values"), struct([f"beta_{n}" for n in names]).alias("hybrid_weights"),
        struct([f"auto_{n}" for n in names]).alias("beta_auto"), "lambda_value", "guard_threshold", "guard_triggered",
        "guard_failures", "instability_penalty_value", (F.col("instability_penalty_value") > 0).alias("global_penalty_applied"),
        "verdict_status", "trust_level", F.col("flags").alias("meta_flags"), F.col("recommendations").alias("meta_recommendations"))
    s = s.select(*K, "trust_mode", "eval_score", "normalized_metrics", "weight_distribution",
                 F.map_filter(F.create_map(*[x for m in metric for x in (F.lit(m), F.col(m).cast("double"))]),
                              lambda k, v: v.isNotNull()).alias("metrics"), result.alias("_r"))
    first = (lambda c, mode: F.max_by(c, F.when(F.col("trust_mode") == mode, 1)))
    out = s.groupBy(*K).agg(F.first("eval_score").alias("eval_score"), *[
        first(c, "balanced").alias(c) for c in ("metrics", "normalized_metrics", "weight_distribution")],
        first("_r", "balanced").alias("_b"), first("_r", "strict").alias("strict_result"))
    return out.select(*K, "eval_score", "metrics", "normalized_metrics", "weight_distribution", F.lit("balanced").alias("trust_mode"),
                      "_b.*", "strict_result")


def refresh_summaries(spark: SparkSession, path: str, preds: DataFrame, attrs: list[str], wanted: DataFrame) -> DataFrame:
    """The sufficient statistics of all ``wanted`` pairs, from the table at ``path`` where a pair is stored there;
    only the predictions of the others are summed, and appended to the table."""
    known = spark.read.parquet(path)
    missing = wanted.select(*K).join(known.select(*K).distinct(), K, "left_anti").distinct()
    if not missing.isEmpty():
        classification_summary(preds.join(missing, K, "left_semi"), attrs).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(*K).distinct(), K, "left_semi")


def evaluate_remainder(spark: SparkSession, sf_dir: str, name: str, path: str, wanted: DataFrame) -> DataFrame:
    """The scored ``wanted`` pairs of a classification workload, evaluating the pairs that ``path`` lacks."""
    wl = WORKLOADS[name]
    summary = refresh_summaries(spark, path, wl.preds(spark, sf_dir), wl.attrs, wanted)
    stats = dataset_stats(wl.dataset(spark, sf_dir), wl.dataset_id, wl.target, model_type=wl.model_type)
    return score(assemble_inputs(*classification_parts_from_summary(summary), stats, wl.model_type))


def flat_record(df: DataFrame) -> DataFrame:
    """Comparable projection: numbers rounded to 6, lists joined to text."""
    r = (lambda c: round_half(F.col(c).cast("double"), 6).alias(c))
    return df.select(
        *K, "trust_mode", r("eval_score"), r("trust_score"), r("trust_score_raw"), r("DII"),
        r("P"), r("H"), r("F"), r("R"), r("lambda_value"),
        *[r(f"beta_{k}") for k in ("performance", "health", "fairness", "robustness")],
        "guard_triggered", "verdict_status", "trust_level",
        F.array_join("flags", ",").alias("flags"),
        F.array_join(F.transform("recommendations", lambda x: x["action"]), " | ").alias("actions"))


def mode_comparison(scored: DataFrame) -> DataFrame:
    """Balanced and strict side by side, gap = balanced − strict."""
    p = (scored.groupBy(*K).pivot("trust_mode", list(MODES))
               .agg(F.first("trust_score").alias("trust"), F.first("DII").alias("dii"),
                    F.first("guard_triggered").alias("guard")))
    return p.withColumn("trust_gap", round_half(F.col("balanced_trust") - F.col("strict_trust"), 2))
