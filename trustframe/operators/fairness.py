"""Group fairness over a predictions table.

Attributes are unpivoted into ``(attr, grp)`` with one ``explode`` right
before the partial aggregation, so the per-row cost is one Expand and the
shuffle carries one row per (pair, attribute, group[, label, prediction]).
The reference compares all group pairs (O(g²)); every pairwise worst gap it
reports is a closed form over the group table:

  max |a_i − a_j|                = max(a) − min(a)
  max max(|Δtpr|, |Δfpr|)        = max(range tpr, range fpr)
  min over ppr>0 pairs of ratio  = min(ppr>0) / max(ppr)  (≥ 2 positive groups, else 1)

so there is no self-join at all.  Null groups are dropped and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.expr import clip, count_if, lit_d, safe_div

K = ["model_id", "dataset_id"]

# Column-name keywords that mark a sensitive attribute.
SENSITIVE_KEYWORDS = [
    "gender", "sex", "race", "ethnicity", "age", "age_group",
    "religion", "nationality", "disability", "marital", "income_group",
    "education", "country", "region", "native", "citizen", "minority",
    "protected", "demographic", "group",
]


def unpivot_attrs(preds: DataFrame, attrs: list[str], keep: list[str]) -> DataFrame:
    """(keep..., attr, attr_ord, grp) — one output row per input row and attribute; without
    attributes one row with null attr, so that counts over all rows still stand."""
    if not attrs:
        null = F.lit(None).cast("string")
        return preds.select(*keep, null.alias("attr"), F.lit(0).alias("attr_ord"), null.alias("grp"))
    arr = F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(i).alias("attr_ord"),
                             F.col(a).cast("string").alias("grp"))
                    for i, a in enumerate(attrs)])
    return preds.select(*keep, F.explode(arr).alias("_a")).select(*keep, "_a.attr", "_a.attr_ord",
                                                                  "_a.grp")


def group_confusion(preds: DataFrame, attrs: list[str], keys: list[str] = K,
                    y_true: str = "y_true", y_pred: str = "y_pred",
                    positive: float = 1.0) -> DataFrame:
    """A5 counts: per (keys, attr, grp): n, tp, fp, tn, fn for labels {0, 1}."""
    long = unpivot_attrs(preds, attrs, [*keys, y_true, y_pred])
    t = F.col(y_true) == positive
    p = F.col(y_pred) == positive
    return (long.groupBy(*keys, "attr", "attr_ord", "grp")
                .agg(F.count(F.lit(1)).alias("n"),
                     count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"),
                     count_if(~t & ~p).alias("tn"), count_if(t & ~p).alias("fn"),
                     count_if(F.col(y_true) == F.col(y_pred)).alias("correct")))


def group_metrics_from_counts(gc: DataFrame) -> DataFrame:
    """A5 rates from the count table (0 when undefined)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return gc.select(
        "*",
        safe_div(F.col("correct"), F.col("n")).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        safe_div(tp, tp + fn).alias("true_positive_rate"),
        safe_div(fp, fp + tn).alias("false_positive_rate"),
        safe_div(tp + fp, F.col("n")).alias("positive_prediction_rate"),
    )


def group_metrics(preds: DataFrame, attrs: list[str], keys: list[str] = K,
                  y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return group_metrics_from_counts(group_confusion(preds, attrs, keys, y_true, y_pred))


def fairness_gaps(gm: DataFrame, keys: list[str] = K) -> DataFrame:
    """A6 + A7: worst gaps per (keys, attr) from the group-metrics table."""
    valid = gm.filter(F.col("grp").isNotNull())
    ppr = F.col("positive_prediction_rate")
    agg = valid.groupBy(*keys, "attr", "attr_ord").agg(
        F.count(F.lit(1)).alias("num_groups"),
        (F.max(ppr) - F.min(ppr)).alias("_dp"),
        (F.max("true_positive_rate") - F.min("true_positive_rate")).alias("_eo"),
        (F.max("false_positive_rate") - F.min("false_positive_rate")).alias("_fpr"),
        (F.max("precision") - F.min("precision")).alias("_pp"),
        F.min(F.when(ppr > 0, ppr)).alias("_min_pos"), F.max(ppr).alias("_max_ppr"),
        count_if(ppr > 0).alias("_n_pos"))
    nulls = gm.filter(F.col("grp").isNull()).groupBy(*keys, "attr").agg(
        F.sum("n").alias("null_group_rows"))
    dp = clip(F.col("_dp"))
    eo = clip(F.col("_eo"))
    eqo = clip(F.greatest(F.col("_eo"), F.col("_fpr")))
    pp = F.greatest(lit_d(0.0), 1 - F.col("_pp"))
    sp = F.greatest(lit_d(0.0), 1 - dp)
    di = F.when(F.col("_n_pos") >= 2, F.col("_min_pos") / F.col("_max_ppr")).otherwise(lit_d(1.0))
    out = agg.select(
        *keys, "attr", "attr_ord", "num_groups",
        (F.col("num_groups") >= 2).alias("analysis_successful"),
        dp.alias("demographic_parity_difference"),
        clip(1 - dp).alias("fairness_score_F"),
        eo.alias("equal_opportunity_difference"),
        di.alias("disparate_impact_ratio"),
        sp.alias("statistical_parity"), pp.alias("predictive_parity"),
        eqo.alias("equalized_odds_difference"))
    overall = ((1 - F.least(F.col("demographic_parity_difference"), lit_d(1.0)))
               + (1 - F.least(F.col("equal_opportunity_difference"), lit_d(1.0)))
               + (1 - F.least(F.col("equalized_odds_difference"), lit_d(1.0)))
               + (1 - F.least(F.abs(F.col("disparate_impact_ratio") - 1), lit_d(1.0)))
               + F.col("statistical_parity") + F.col("predictive_parity")) / 6.0
    out = out.withColumn("overall_fairness_score", overall)
    return (out.join(nulls, [*keys, "attr"], "left")
               .withColumn("null_group_rows", F.coalesce("null_group_rows", F.lit(0)).cast("long")))


def regression_group_stats(preds: DataFrame, attrs: list[str], keys: list[str] = K,
                           y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A8 first level: per (keys, attr, grp) mean pred / true, MAE, RMSE."""
    long = unpivot_attrs(preds, attrs, [*keys, y_true, y_pred])
    e = F.col(y_true).cast("double") - F.col(y_pred).cast("double")
    return (long.groupBy(*keys, "attr", "attr_ord", "grp")
                .agg(F.count(F.lit(1)).alias("sample_count"),
                     F.avg(y_pred).alias("mean_prediction"), F.avg(y_true).alias("mean_actual"),
                     F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                     F.min(y_pred).alias("_min_pred"), F.max(y_pred).alias("_max_pred")))


def regression_fairness(gs: DataFrame, keys: list[str] = K) -> DataFrame:
    """A8 second level: normalised DP and error parity per (keys, attr)."""
    valid = gs.filter(F.col("grp").isNotNull())
    agg = valid.groupBy(*keys, "attr", "attr_ord").agg(
        F.count(F.lit(1)).alias("num_groups"),
        (F.max("mean_prediction") - F.min("mean_prediction")).alias("max_prediction_gap"),
        (F.max("mae") - F.min("mae")).alias("max_mae_gap"),
        (F.max("_max_pred") - F.min("_min_pred")).alias("_pred_range"),
        F.avg("mae").alias("_mean_mae"))
    ndp = F.least(lit_d(1.0), F.col("max_prediction_gap")
                  / F.greatest(F.col("_pred_range"), lit_d(1e-10)))
    nep = F.least(lit_d(1.0), F.col("max_mae_gap") / F.greatest(F.col("_mean_mae"), lit_d(1e-10)))
    return agg.select(
        *keys, "attr", "attr_ord", "num_groups",
        (F.col("num_groups") >= 2).alias("analysis_successful"),
        ndp.alias("demographic_parity_difference"),
        F.greatest(lit_d(0.0), 1 - ndp).alias("fairness_score_F"),
        nep.alias("error_parity_difference"),
        "max_prediction_gap", "max_mae_gap",
        ((F.greatest(lit_d(0.0), 1 - ndp) + (1 - nep)) / 2).alias("overall_fairness_score"))


def fairness_summary(gaps: DataFrame, keys: list[str] = K) -> DataFrame:
    """Worst case over attributes; the primary (first) attribute drives
    the trust score.  ``fairness_attempted`` is the reference's
    ``analysis_successful`` (true when any attribute was analysed);
    ``fairness_evaluated`` is whether the primary attribute succeeded."""
    by_key = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attributes_analyzed"),
        F.min(F.when(F.col("analysis_successful"), F.col("fairness_score_F"))).alias("_minf"),
        F.min_by(F.struct("attr", "analysis_successful", "demographic_parity_difference",
                          "overall_fairness_score"), F.col("attr_ord")).alias("_p"))
    return by_key.select(
        *keys, "attributes_analyzed",
        F.lit(True).alias("fairness_attempted"),
        F.least(lit_d(1.0), F.coalesce(F.col("_minf"), lit_d(1.0))).alias("overall_fairness_score"),
        F.col("_p.attr").alias("primary_attribute"),
        F.col("_p.analysis_successful").alias("fairness_evaluated"),
        F.when(F.col("_p.analysis_successful"), F.col("_p.demographic_parity_difference")).alias("dp"),
        F.when(F.col("_p.analysis_successful"), F.col("_p.overall_fairness_score"))
         .alias("primary_overall_fairness"))


def binary_demographic_parity(preds: DataFrame, attr: str, keys: list[str] = K,
                              y_pred: str = "y_pred") -> DataFrame:
    """Max − min positive-prediction rate over the groups of one attribute."""
    rates = (preds.filter(F.col(attr).isNotNull())
                  .groupBy(*keys, F.col(attr).alias("grp"))
                  .agg(F.avg(F.col(y_pred).cast("double")).alias("rate")))
    return rates.groupBy(*keys).agg((F.max("rate") - F.min("rate")).alias("demographic_parity"))


# Fairness recommendation texts.
FAIRNESS_RECS = {
    "dp": ("High demographic parity difference detected. Consider rebalancing your training data "
           "or applying fairness constraints during model training."),
    "eo": ("Significant equal opportunity difference found. The model has different true positive "
           "rates across groups. Consider post-processing techniques to equalize opportunities."),
    "di": ("Disparate impact detected. The ratio of positive predictions differs significantly "
           "between groups. Review feature selection and consider bias mitigation techniques."),
    "ok": ("Your model shows good fairness characteristics. Continue monitoring fairness "
           "metrics as you retrain or update the model."),
}


def fairness_recommendations(gaps: DataFrame) -> DataFrame:
    """DP > .2, EO > .2, DI outside [.8, 1.25], else the 'good' text."""
    recs = F.array_compact(F.array(
        F.when(F.coalesce("demographic_parity_difference", lit_d(0)) > 0.2, F.lit(FAIRNESS_RECS["dp"])),
        F.when(F.coalesce("equal_opportunity_difference", lit_d(0)) > 0.2, F.lit(FAIRNESS_RECS["eo"])),
        F.when((F.coalesce("disparate_impact_ratio", lit_d(1)) < 0.8)
               | (F.coalesce("disparate_impact_ratio", lit_d(1)) > 1.25), F.lit(FAIRNESS_RECS["di"]))))
    return gaps.withColumn("fairness_recommendations",
                           F.when(F.size(recs) == 0, F.array(F.lit(FAIRNESS_RECS["ok"])))
                            .otherwise(recs))


def fairness_level(overall: Column) -> Column:
    """Overall fairness band."""
    return (F.when(overall >= 0.9, F.lit("excellent")).when(overall >= 0.75, F.lit("good"))
             .when(overall >= 0.6, F.lit("fair")).otherwise(F.lit("poor")))


def metric_label(metric: Column, value: Column) -> Column:
    """Per-metric label: differences ≤.1/.2, ratios in [.8,1.25]/[.6,1.5], other ≥.8/.6."""
    is_diff = metric.endswith("_difference")
    is_ratio = metric.endswith("_ratio")
    return (F.when(is_diff, F.when(value <= 0.1, F.lit("good")).when(value <= 0.2, F.lit("fair"))
                   .otherwise(F.lit("poor")))
             .when(is_ratio, F.when((value >= 0.8) & (value <= 1.25), F.lit("good"))
                   .when((value >= 0.6) & (value <= 1.5), F.lit("fair")).otherwise(F.lit("poor")))
             .otherwise(F.when(value >= 0.8, F.lit("good")).when(value >= 0.6, F.lit("fair"))
                        .otherwise(F.lit("poor"))))


def trust_band(score: Column) -> Column:
    """A trust score's band."""
    return F.when(score >= 70, F.lit("High Trust")).when(score >= 40, F.lit("Moderate Trust")).when(score.isNotNull(), F.lit("Low Trust"))


def dii_band(dii: Column) -> Column:
    """The instability index's band, 1 (stable) to 4."""
    return F.when(dii <= 0.15, 1).when(dii <= 0.30, 2).when(dii <= 0.50, 3).when(dii.isNotNull(), 4)


def labelled_metrics(gaps: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a metric that has a value, with its label; the other columns stay."""
    keep = [c for c in gaps.columns if c not in metrics]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])
    long = gaps.select(*keep, F.inline(cells)).filter(F.col("value").isNotNull())
    return long.withColumn("label", metric_label(F.col("metric"), F.col("value")))


def detect_sensitive_attributes(df: DataFrame, exclude: list[str] | None = None,
                                dataset_id: str = "dataset") -> DataFrame:
    """A10: by name keyword, else string with 2–10 distinct, else numeric
    (booleans included) with 2–5 distinct; the target is excluded.

    A first scan marks each value's hash in 64 bits a column: a column with more bits set than its
    bound surely has more values, and is left out without being counted.  Distinct values are
    counted only in what is left and in columns that their name decides; the result is a small
    (dataset_id, column, ordinal, reason) table.  A column without values is never one by its values."""
    from pyspark.sql import types as T
    exclude = set(exclude or [])
    cand = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in exclude]
    if not cand:
        return df.sparkSession.createDataFrame(
            [], "dataset_id string, column string, ordinal int, reason string, n_unique long")
    by_name = {f.name for _, f in cand if any(k in f.name.lower() for k in SENSITIVE_KEYWORDS)}
    bound = {i: 10 if isinstance(f.dataType, T.StringType) else 5 for i, f in cand
             if f.name not in by_name and isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType))}
    # floats by their bits with one zero, as distinct values count 0.0 and -0.0 as one
    mark = (lambda c: F.when(c.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))))
    one_zero = (lambda f: F.col(f"`{f.name}`") + 0.0 if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`"))
    bits = [(i, F.bit_count(F.bit_or(mark(one_zero(f)))).alias(f"b{i}")) for i, f in cand if i in bound]
    seen = df.agg(*[b for _, b in bits]).first().asDict() if bits else {}  # one row of a number a column
    cand = [(i, f) for i, f in cand if f.name in by_name or (i in bound and (seen[f"b{i}"] or 0) <= bound[i])]
    if not cand:
        return df.sparkSession.createDataFrame(
            [], "dataset_id string, column string, ordinal int, reason string, n_unique long")
    nd = df.agg(*[F.count_distinct(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in cand])
    entries = []
    for i, f in cand:
        dt = f.dataType
        is_str = isinstance(dt, T.StringType)
        is_num = isinstance(dt, (T.NumericType, T.BooleanType))
        n = F.col(f"c{i}")
        if f.name in by_name:
            cond, reason = F.lit(True), "name"
        elif is_str:
            cond, reason = (n >= 2) & (n <= 10), "categorical"
        elif is_num:
            cond, reason = (n >= 2) & (n <= 5), "numeric"
        else:
            continue
        entries.append(F.when(cond, F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
                                             F.lit(reason).alias("reason"), n.alias("n_unique"))))
    if not entries:
        return df.sparkSession.createDataFrame(
            [], "dataset_id string, column string, ordinal int, reason string, n_unique long")
    return (nd.select(F.explode(F.array_compact(F.array(*entries))).alias("d"))
              .select(F.lit(dataset_id).alias("dataset_id"), "d.column", "d.ordinal", "d.reason",
                      "d.n_unique"))
