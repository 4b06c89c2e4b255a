"""A1–A4: quality metrics per (model, dataset) over a predictions table.

Every metric is a keyed aggregation with map-side partial aggregation, so a
pair that holds a third of all rows is combined inside each map task before
the shuffle; the shuffled data is one row per (pair, class pair) at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.functions.expr import count_if, lit_d, safe_div

K = ["model_id", "dataset_id"]


def confusion(preds: DataFrame, keys: list[str] = K, y_true: str = "y_true",
              y_pred: str = "y_pred") -> DataFrame:
    """(keys, y_true, y_pred, n): the multi-class confusion table."""
    return (preds.filter(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
                 .groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
                 .agg(F.count(F.lit(1)).alias("n")))


def per_class(conf: DataFrame, keys: list[str] = K) -> DataFrame:
    """Per label in y_true ∪ y_pred: support, predicted, tp (one pass, no join)."""
    sides = F.explode(F.array(
        F.struct(F.col("y_true").cast("string").alias("cls"), F.col("n").alias("support"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("y_pred").cast("string").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted"))))
    return (conf.select(*keys, sides.alias("s"))
                .groupBy(*keys, F.col("s.cls").alias("cls"))
                .agg(F.sum("s.support").alias("support"), F.sum("s.tp").alias("tp"),
                     F.sum("s.predicted").alias("predicted")))


def classification_metrics(preds: DataFrame, keys: list[str] = K, y_true: str = "y_true",
                           y_pred: str = "y_pred") -> DataFrame:
    """A1: accuracy and support-weighted precision / recall / F1 (0 when a
    class has no predictions), over labels in y_true ∪ y_pred."""
    return metrics_from_confusion(confusion(preds, keys, y_true, y_pred), keys)


def metrics_from_confusion(conf: DataFrame, keys: list[str] = K) -> DataFrame:
    """A1 from a (keys, y_true, y_pred, n) confusion table."""
    pc = per_class(conf, keys)
    prec_c = safe_div(F.col("tp"), F.col("predicted"))
    rec_c = safe_div(F.col("tp"), F.col("support"))
    f1_c = safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    agg = pc.groupBy(*keys).agg(
        F.sum("support").alias("n_rows"), F.sum("tp").alias("_tp"),
        F.sum(F.col("support") * prec_c).alias("_wp"),
        F.sum(F.col("support") * rec_c).alias("_wr"),
        F.sum(F.col("support") * f1_c).alias("_wf"))
    n = F.col("n_rows")
    return agg.select(*keys, n.alias("n_rows"),
                      safe_div(F.col("_tp"), n).alias("accuracy"),
                      safe_div(F.col("_wp"), n).alias("precision"),
                      safe_div(F.col("_wr"), n).alias("recall"),
                      safe_div(F.col("_wf"), n).alias("f1_score"))


def binary_metrics(preds: DataFrame, keys: list[str] = K, y_true: str = "y_true",
                   y_pred: str = "y_pred", positive: float = 1.0) -> DataFrame:
    """A2: precision / recall / F1 of the positive class, zero-division 0."""
    t = F.col(y_true) == positive
    p = F.col(y_pred) == positive
    agg = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"),
        count_if(t & ~p).alias("fn"), count_if(~t & ~p).alias("tn"))
    return agg.select(
        *keys, "n_rows", "tp", "fp", "fn", "tn",
        safe_div(F.col("tp") + F.col("tn"), F.col("n_rows")).alias("accuracy"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"))


def regression_metrics(preds: DataFrame, keys: list[str] = K, y_true: str = "y_true",
                       y_pred: str = "y_pred") -> DataFrame:
    """A3: MAE, MSE, RMSE, R² = 1 − SSres/SStot, plus the population std and
    range of y that EvalScore uses as its error scale."""
    e = F.col(y_pred).cast("double") - F.col(y_true).cast("double")
    agg = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_ssres"), F.var_pop(F.col(y_true).cast("double")).alias("_varp"),
        F.stddev_pop(F.col(y_true).cast("double")).alias("std_y"),
        (F.max(y_true) - F.min(y_true)).cast("double").alias("range_y"))
    sstot = F.col("_varp") * F.col("n_rows")
    # sklearn's force_finite rule: constant y gives 1 for a perfect fit, else 0
    r2 = (F.when(sstot > 0, 1 - F.col("_ssres") / sstot)
           .when(F.col("_ssres") == 0, lit_d(1.0)).otherwise(lit_d(0.0)))
    return agg.select(*keys, "n_rows", "mae", "mse", F.sqrt("mse").alias("rmse"),
                      r2.alias("r2_score"), "std_y", "range_y")


def pixel_metrics(preds: DataFrame, keys: list[str] = K, y_true: str = "y_true",
                  y_pred: str = "y_pred", fixed: bool = False) -> DataFrame:
    """A4: pixel accuracy, IoU and Dice as the reference defines them
    (matches/n and 2·matches/2n, so all three equal accuracy — quirk Q2).
    ``fixed=True`` gives mean per-class IoU and Dice from the confusion table."""
    if not fixed:
        m = F.avg(F.when(F.col(y_true) == F.col(y_pred), 1.0).otherwise(0.0))
        return (preds.groupBy(*keys)
                     .agg(F.count(F.lit(1)).alias("n_rows"), m.alias("pixel_accuracy"))
                     .withColumn("iou", F.col("pixel_accuracy"))
                     .withColumn("dice_coefficient", F.col("pixel_accuracy")))
    pc = per_class(confusion(preds, keys, y_true, y_pred), keys)
    iou_c = safe_div(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp"))
    dice_c = safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return pc.groupBy(*keys).agg(
        F.sum("support").alias("n_rows"),
        safe_div(F.sum("tp"), F.sum("support")).alias("pixel_accuracy"),
        F.avg(iou_c).alias("iou"), F.avg(dice_c).alias("dice_coefficient"))
