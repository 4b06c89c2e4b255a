"""EvalScore and the hybrid trust score as Column expressions.

Input is an *evaluations* table with one row per (model, dataset[, mode]) and
nullable metric / statistic columns ("absent" = null).  Nothing here
aggregates or shuffles: every function returns Columns or adds columns with
one projection, so the whole scorer is a single whole-stage-codegen span.

Columns read (all nullable unless noted):
  model_type (string, required)
  accuracy precision recall f1_score mae mse rmse r2_score
  bleu_score rouge1 rouge2 rougeL pixel_accuracy iou dice_coefficient
  std_y range_y                                   (EvalScore error scale)
  n_rows n_features missing_values imbalance_ratio duplicate_ratio
  skew_score low_variance_fraction                 (dataset statistics)
  fairness_evaluated (boolean) dp                 (fairness result)
  has_train (boolean) train_accuracy train_f1_score train_r2_score
  w_performance w_health w_fairness w_robustness  (user weights, optional)
  trust_mode ('balanced' | 'strict')
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.expr import clip, lit_d, round_half

# Metric weights of the EvalScore per model type.
METRIC_WEIGHTS = {
    "classification": {"accuracy": 0.25, "precision": 0.25, "recall": 0.25, "f1_score": 0.25},
    "regression": {"r2_score": 0.4, "mae": 0.3, "rmse": 0.3},
    "nlp": {"bleu_score": 0.4, "rouge_score": 0.4, "perplexity": 0.2},
    "computer_vision": {"accuracy": 0.3, "iou": 0.35, "dice_coefficient": 0.35},
}
COST_METRICS = ("mae", "mse", "rmse", "perplexity")

# Trust-scorer constants.
EPS = 1e-12
GUARD_BALANCED = 0.30
GUARD_STRICT = 0.40
STRICT_POWER = 1.5
STRICT_LAMBDA_POWER = 1.5
INSTABILITY_PENALTY = 0.15
LAMBDA_CAP = 0.85
MIN_WEIGHT_FLOOR = 0.05
DEFAULT_USER_WEIGHTS = {"performance": 0.40, "health": 0.25, "fairness": 0.20, "robustness": 0.15}
COMPONENTS = ("performance", "health", "fairness", "robustness")


def _c(name: str) -> Column:
    return F.col(name)


def _present(df_cols: set[str], name: str) -> Column:
    return _c(name) if name in df_cols else F.lit(None).cast("double")


# ---------------------------------------------------------------- T1 EvalScore

def error_scale(std_y: Column, range_y: Column) -> Column:
    """Population std of y; range/4 for a near-constant y; else 1."""
    s = (F.when(std_y >= 1e-10, std_y)
          .when(range_y > 1e-10, range_y / 4.0)
          .otherwise(F.lit(None).cast("double")))
    return F.when(s > 1e-10, s).otherwise(lit_d(1.0))


def normalized_metric(name: str, value: Column, scale: Column) -> Column:
    if name in COST_METRICS:
        div = scale * scale if name == "mse" else scale
        return F.when(value >= 0, clip(1.0 / (1.0 + value / div))).otherwise(lit_d(0.0))
    return clip(value)


def eval_score_columns(df: DataFrame) -> DataFrame:
    """Add ``eval_score`` (0–100, 2 places).

    Missing metrics add 0 with no re-weighting, as in the reference."""
    values, scale = _score_parts(set(df.columns))
    total = None
    for mtype, weights in METRIC_WEIGHTS.items():
        s = lit_d(0.0)
        for m, w in weights.items():
            s = s + F.coalesce(normalized_metric(m, values[m], scale) * w, lit_d(0.0))
        total = (F.when(_c("model_type") == mtype, s) if total is None
                 else total.when(_c("model_type") == mtype, s))
    total = total.otherwise(lit_d(0.0))
    score = round_half(F.least(lit_d(100.0), F.greatest(lit_d(0.0), total * 100.0)), 2)
    return df.withColumn("eval_score", score)


def score_maps(df: DataFrame) -> DataFrame:
    """Add ``normalized_metrics`` (metrics that the row has) and ``weight_distribution`` (every metric of
    its model type) as maps by metric."""
    values, scale = _score_parts(set(df.columns))
    norm = weight = None
    for mtype, weights in METRIC_WEIGHTS.items():
        n = F.map_filter(F.create_map(*[x for m in weights for x in (F.lit(m), F.when(values[m].isNotNull(), normalized_metric(m, values[m], scale)))]),
                         lambda k, v: v.isNotNull())
        w = F.create_map(*[x for m, v in weights.items() for x in (F.lit(m), lit_d(v))])
        is_type = _c("model_type") == mtype
        norm = F.when(is_type, n) if norm is None else norm.when(is_type, n)
        weight = F.when(is_type, w) if weight is None else weight.when(is_type, w)
    return df.withColumn("normalized_metrics", norm).withColumn("weight_distribution", weight)


def _score_parts(cols: set[str]) -> tuple[dict[str, Column], Column]:
    """The value of each scored metric, and the scale of error metrics."""
    rouge_parts = [c for c in ("rouge1", "rouge2", "rougeL") if c in cols]
    rouge = (sum((F.coalesce(_c(c), lit_d(0.0)) for c in rouge_parts), lit_d(0.0))
             / max(1, len(rouge_parts))) if rouge_parts else F.lit(None).cast("double")
    if rouge_parts:
        rouge = F.when(F.greatest(*[_c(c).isNotNull() for c in rouge_parts]), rouge)
    scale = error_scale(_present(cols, "std_y"), _present(cols, "range_y"))
    return {m: (rouge if m == "rouge_score" else _present(cols, m)) for w in METRIC_WEIGHTS.values() for m in w}, scale


# ------------------------------------------------------------- T2–T5 components

def performance_score(cols: set[str]) -> Column:
    f1, acc = _present(cols, "f1_score"), _present(cols, "accuracy")
    r2, mse = _present(cols, "r2_score"), _present(cols, "mse")
    cls = clip(F.coalesce(f1, acc, lit_d(0.5)))
    reg = (F.when(r2.isNotNull(), clip(F.greatest(lit_d(0.0), r2)))
            .when(mse.isNotNull(), 1.0 / (1.0 + mse)).otherwise(lit_d(0.5)))
    return F.when(_c("trust_model_type") == "classification", cls).otherwise(reg)


def dii_parts(cols: set[str]) -> dict[str, Column]:
    n_rows = F.greatest(F.lit(1), F.coalesce(_present(cols, "n_rows"), F.lit(1)))
    n_feat = F.greatest(F.lit(1), F.coalesce(_present(cols, "n_features"), F.lit(1)))
    imb = F.coalesce(_present(cols, "imbalance_ratio"), lit_d(0.5))
    i = F.least(lit_d(1.0), F.abs(imb - 0.5) * 2.0)
    m = clip(F.coalesce(_present(cols, "missing_values"), F.lit(0)).cast("double")
             / (n_rows.cast("double") * n_feat))
    d = clip(F.coalesce(_present(cols, "duplicate_ratio"), lit_d(0.0)))
    skew = F.coalesce(_present(cols, "skew_score"), lit_d(0.0))
    s = F.when(skew == 0.0, clip(F.coalesce(_present(cols, "low_variance_fraction"), lit_d(0.0)))) \
         .otherwise(clip(skew))
    return {"I": i, "M": m, "D": d, "S": s}


def dii_value(parts: dict[str, Column], strict: Column, rounded: bool = True) -> Column:
    i, m, d, s = parts["I"], parts["M"], parts["D"], parts["S"]
    bal = 0.35 * m + 0.30 * i + 0.20 * d + 0.15 * s
    stri = 1.0 - (1.0 - i) * (1.0 - m) * (1.0 - d) * (1.0 - s)
    v = clip(F.when(strict, stri).otherwise(bal))
    return round_half(v, 4) if rounded else v


def robustness_delta(cols: set[str]) -> Column:
    cls = _c("trust_model_type") == "classification"
    f1, acc = _present(cols, "f1_score"), _present(cols, "accuracy")
    tf1, tacc = _present(cols, "train_f1_score"), _present(cols, "train_accuracy")
    r2, tr2 = _present(cols, "r2_score"), _present(cols, "train_r2_score")
    train_perf = F.when(cls, F.coalesce(tf1, tacc, lit_d(1.0))).otherwise(F.coalesce(tr2, lit_d(1.0)))
    test_perf = F.when(cls, F.coalesce(f1, acc, lit_d(1.0))).otherwise(F.coalesce(r2, lit_d(1.0)))
    gap = F.abs(train_perf - test_perf)
    with_train = F.when(F.abs(train_perf) > 1e-10, gap / F.abs(train_perf)).otherwise(gap)
    prec = F.coalesce(_present(cols, "precision"), lit_d(0.5))
    rec = F.coalesce(_present(cols, "recall"), lit_d(0.5))
    no_train = F.when(cls, F.abs(prec - rec) * 0.5).otherwise(
        (1.0 - F.greatest(lit_d(0.0), F.coalesce(r2, lit_d(0.5)))) * 0.3)
    has_train = F.coalesce(_present(cols, "has_train").cast("boolean"), F.lit(False))
    return clip(F.when(has_train, with_train).otherwise(no_train))


# ------------------------------------------------------------------ T6–T16

def trust_columns(df: DataFrame, lambda_cap: float = LAMBDA_CAP,
                  instability_penalty: float = INSTABILITY_PENALTY,
                  with_text: bool = True) -> DataFrame:
    """Add the full trust result for the mode in ``trust_mode``."""
    cols = set(df.columns)
    if "trust_model_type" not in cols:
        df = df.withColumn("trust_model_type", F.when(_c("model_type") == "classification",
                                                      F.lit("classification"))
                           .otherwise(F.lit("regression")))
        cols.add("trust_model_type")
    strict = _c("trust_mode") == "strict"
    parts = dii_parts(cols)
    fe = F.coalesce(_present(cols, "fairness_evaluated").cast("boolean"), F.lit(False))
    df = df.select(
        "*",
        clip(performance_score(cols)).alias("P"),
        dii_value(parts, strict).alias("DII"),
        *[p.alias(f"dii_{k}") for k, p in parts.items()],
        fe.alias("fairness_evaluated_"),
        F.when(fe, clip(_present(cols, "dp"))).otherwise(lit_d(0.5)).alias("dp_value"),
        robustness_delta(cols).alias("delta"),
    )
    df = df.select(
        "*",
        clip(1.0 - _c("DII")).alias("H"),
        clip(F.when(_c("fairness_evaluated_"), 1.0 - _c("dp_value")).otherwise(lit_d(0.5))).alias("F"),
        clip(1.0 - _c("delta")).alias("R"),
    )
    amp = (lambda r: F.when(strict, clip(F.pow(r, STRICT_POWER))).otherwise(r))
    df = df.select(
        "*",
        amp(clip(1.0 - _c("P"))).alias("r_P"),
        amp(clip(_c("DII"))).alias("r_H"),
        F.when(_c("fairness_evaluated_"), amp(clip(_c("dp_value")))).alias("r_F"),
        amp(clip(_c("delta"))).alias("r_R"),
    )
    fe = _c("fairness_evaluated_")
    risk_sum = _c("r_P") + _c("r_H") + _c("r_R") + F.coalesce(_c("r_F"), lit_d(0.0))
    df = df.withColumn("risk_sum", risk_sum)
    eq = F.when(fe, lit_d(0.25)).otherwise(lit_d(1.0 / 3.0))
    raw_auto = {
        "performance": F.when(_c("risk_sum") > EPS, _c("r_P") / _c("risk_sum")).otherwise(eq),
        "health": F.when(_c("risk_sum") > EPS, _c("r_H") / _c("risk_sum")).otherwise(eq),
        "fairness": F.when(fe, F.when(_c("risk_sum") > EPS, _c("r_F") / _c("risk_sum"))
                           .otherwise(eq)).otherwise(lit_d(0.0)),
        "robustness": F.when(_c("risk_sum") > EPS, _c("r_R") / _c("risk_sum")).otherwise(eq),
    }
    floored = {k: (F.greatest(v, lit_d(MIN_WEIGHT_FLOOR)) if k != "fairness"
                   else F.when(fe, F.greatest(v, lit_d(MIN_WEIGHT_FLOOR))).otherwise(lit_d(0.0)))
               for k, v in raw_auto.items()}
    df = df.select("*", *[v.alias(f"_fa_{k}") for k, v in floored.items()])
    ftot = sum((_c(f"_fa_{k}") for k in COMPONENTS), lit_d(0.0))
    df = df.select("*", *[(_c(f"_fa_{k}") / ftot).alias(f"auto_{k}") for k in COMPONENTS])

    # user weights: defaults when none given; a partial set defaults the rest to 0.25
    uw_cols = [f"w_{k}" for k in COMPONENTS]
    any_user = F.lit(False)
    for c in uw_cols:
        any_user = any_user | _present(cols, c).isNotNull()
    user = {k: F.when(any_user, F.coalesce(_present(cols, f"w_{k}"), lit_d(0.25)))
               .otherwise(lit_d(DEFAULT_USER_WEIGHTS[k])) for k in COMPONENTS}
    f_user = F.when(any_user, F.coalesce(_present(cols, "w_fairness"), lit_d(0.20))) \
              .otherwise(lit_d(DEFAULT_USER_WEIGHTS["fairness"]))
    user_eff = {k: (F.when(fe, user[k]).otherwise(lit_d(0.0)) if k == "fairness"
                    else F.when(fe, user[k]).otherwise(user[k] + f_user / 3.0))
                for k in COMPONENTS}
    lam_adj = F.when(strict, clip(F.pow(_c("DII"), STRICT_LAMBDA_POWER))).otherwise(_c("DII"))
    df = df.select("*", *[v.alias(f"user_{k}") for k, v in user_eff.items()],
                   F.least(lam_adj, lit_d(lambda_cap)).alias("lambda_value"))
    lam = _c("lambda_value")
    hyb = {k: (lam * _c(f"auto_{k}") + (1.0 - lam) * _c(f"user_{k}")) for k in COMPONENTS}
    hyb["fairness"] = F.when(fe, hyb["fairness"]).otherwise(lit_d(0.0))
    df = df.select("*", *[v.alias(f"_hb_{k}") for k, v in hyb.items()])
    wsum = sum((_c(f"_hb_{k}") for k in COMPONENTS), lit_d(0.0))
    df = df.withColumn("_wsum", wsum)
    beta = {k: F.when(_c("_wsum") > EPS, _c(f"_hb_{k}") / _c("_wsum")).otherwise(
        (F.when(fe, lit_d(0.25)).otherwise(lit_d(0.0)) if k == "fairness" else eq))
        for k in COMPONENTS}
    df = df.select("*", *[v.alias(f"beta_{k}") for k, v in beta.items()])
    comp = {"performance": "P", "health": "H", "fairness": "F", "robustness": "R"}
    raw = 100.0 * (_c("beta_performance") * _c("P") + _c("beta_health") * _c("H")
                   + F.when(fe, _c("beta_fairness") * _c("F")).otherwise(lit_d(0.0))
                   + _c("beta_robustness") * _c("R"))
    df = df.withColumn("trust_score_raw_", raw)
    penalty = F.when(strict, lit_d(instability_penalty) * _c("DII")).otherwise(lit_d(0.0))
    trust = F.greatest(lit_d(0.0), F.least(lit_d(100.0), _c("trust_score_raw_") * (1.0 - penalty)))
    tau = F.when(strict, lit_d(GUARD_STRICT)).otherwise(lit_d(GUARD_BALANCED))
    failures = F.filter(F.array(
        F.struct(F.lit("performance").alias("component"), _c("P").alias("score")),
        F.struct(F.lit("health").alias("component"), _c("H").alias("score")),
        F.struct(F.lit("robustness").alias("component"), _c("R").alias("score")),
        F.struct(F.lit("fairness").alias("component"),
                 F.when(fe, _c("F")).alias("score"))),
        lambda x: x["score"].isNotNull() & (x["score"] < tau))
    df = df.select("*", trust.alias("trust_score_"), penalty.alias("instability_penalty_value"),
                   tau.alias("guard_threshold"), failures.alias("guard_failures"))
    df = df.withColumn("guard_triggered", F.size("guard_failures") > 0)
    df = _flags(df, cols)
    df = _verdict(df)
    if with_text:
        df = _recommendations(df, cols)
    out = df.select(
        "*",
        round_half(_c("trust_score_"), 2).alias("trust_score"),
        round_half(_c("trust_score_raw_"), 2).alias("trust_score_raw"),
        *[round_half(_c(comp[k]) * 100.0, 2).alias(f"{k}_score") for k in COMPONENTS],
        *[round_half(_c(comp[k]) * _c(f"beta_{k}") * 100.0, 2).alias(f"{k}_contribution")
          for k in COMPONENTS],
    )
    drop = [c for c in out.columns if c.startswith("_")]
    return out.drop(*drop)


# Flag thresholds and names, in the order the reference emits them.
def _flags(df: DataFrame, cols: set[str]) -> DataFrame:
    fe = _c("fairness_evaluated_")
    dii, dp, delta = _c("DII"), _c("dp_value"), _c("delta")
    n_rows = F.coalesce(_present(cols, "n_rows"), F.lit(1))
    n_feat = F.coalesce(_present(cols, "n_features"), F.lit(1))
    miss = F.coalesce(_present(cols, "missing_values"), F.lit(0)).cast("double") \
        / F.greatest(F.lit(1), n_rows * n_feat)
    imb = F.coalesce(_present(cols, "imbalance_ratio"), lit_d(0.5))
    low_var = F.coalesce(_present(cols, "low_variance_fraction"), lit_d(0.0))
    cls = _c("trust_model_type") == "classification"
    prec = F.coalesce(_present(cols, "precision"), lit_d(0.0))
    rec = F.coalesce(_present(cols, "recall"), lit_d(0.0))
    acc = F.coalesce(_present(cols, "accuracy"), lit_d(0.0))
    r2 = F.coalesce(_present(cols, "r2_score"), lit_d(0.0))
    s = lambda x: F.lit(x)
    flags = F.array_compact(F.array(
        F.when(~fe, s("fairness_unverified")),
        F.when(dii > 0.7, s("critical_dataset_instability"))
         .when(dii > 0.5, s("high_dataset_instability"))
         .when(dii > 0.3, s("moderate_dataset_instability")),
        F.when(fe & (dp > 0.3), s("severe_fairness_violation"))
         .when(fe & (dp > 0.2), s("significant_bias_detected"))
         .when(fe & (dp > 0.1), s("mild_bias_detected")),
        F.when(delta > 0.3, s("severe_overfitting"))
         .when(delta > 0.2, s("significant_overfitting"))
         .when(delta > 0.1, s("mild_overfitting")),
        F.when(miss > 0.1, s("high_missing_values")),
        F.when(imb > 0.8, s("severe_class_imbalance")).when(imb > 0.7, s("moderate_class_imbalance")),
        F.when(F.coalesce(_present(cols, "n_rows"), F.lit(0)) < 100, s("small_sample_size")),
        F.when(low_var > 0.3, s("many_low_variance_features")),
        F.when(cls & (F.abs(prec - rec) > 0.15), s("precision_recall_imbalance")),
        F.when(cls & (acc < 0.6), s("critical_low_accuracy")).when(cls & (acc < 0.7), s("low_accuracy")),
        F.when(~cls & (r2 < 0), s("negative_r2_warning"))
         .when(~cls & (r2 < 0.3), s("critical_low_r2"))
         .when(~cls & (r2 < 0.5), s("low_r2_score")),
    ))
    return df.withColumn("flags", flags)


def _critical_count() -> Column:
    return F.size(F.filter(_c("flags"), lambda f: f.contains("severe") | f.contains("critical")
                           | f.contains("negative")))


def trust_level(score: Column) -> Column:
    return (F.when(score >= 90, F.lit("excellent")).when(score >= 80, F.lit("good"))
             .when(score >= 70, F.lit("acceptable")).when(score >= 50, F.lit("questionable"))
             .otherwise(F.lit("poor")))


def _verdict(df: DataFrame) -> DataFrame:
    fe = _c("fairness_evaluated_")
    t = _c("trust_score_")
    crit = _critical_count()
    suffix = F.when(fe, F.lit("")).otherwise(F.lit(" (Fairness Unverified)"))
    audit = F.when(fe, F.lit("")).otherwise(F.lit(" — run fairness audit first"))
    # Q5: conditional_trust is unreachable (high/moderate already need zero critical flags)
    status = (F.when(_c("guard_triggered"), F.lit("high_risk"))
               .when((t >= 85) & (crit == 0), F.lit("high_trust"))
               .when((t >= 70) & (crit == 0), F.lit("moderate_trust"))
               .when(t >= 50, F.lit("low_trust")).otherwise(F.lit("untrusted")))
    details = F.array_join(F.transform(
        _c("guard_failures"),
        lambda x: F.concat(x["component"], F.lit("="), F.format_string("%.2f", x["score"]))), ", ")
    # Verdict messages.
    message = (F.when(_c("guard_triggered"),
                      F.concat(F.lit("🚨 HIGH RISK - Critical component failure: "), details))
                .when(status == "high_trust", F.concat(F.lit("✅ HIGH TRUST - Production ready"), audit))
                .when(status == "moderate_trust",
                      F.concat(F.lit("✅ MODERATE TRUST - Production ready with monitoring"), audit))
                .when(status == "low_trust", F.lit("⚠️ LOW TRUST - Improvements needed before production"))
                .otherwise(F.lit("❌ UNTRUSTED - Do not deploy")))
    return df.select(
        "*", status.alias("verdict_status"), F.concat(message, suffix).alias("verdict_message"),
        F.when(_c("guard_triggered"), F.size("guard_failures")).otherwise(crit).alias("critical_issues"),
        F.size("flags").alias("total_issues"),
        F.when(_c("guard_triggered"), F.lit("critical")).otherwise(trust_level(t)).alias("trust_level"))


_REC = "struct<action:string,why:string,priority:string,component:string>"
PRIORITY_ORDER = ("critical", "high", "medium", "low")

# Recommendations emitted for flags (action, why, priority, component).
FLAG_RECOMMENDATIONS = [
    ("high_missing_values", "Handle missing values with imputation or removal",
     "Missing values can bias model predictions and reduce trust", "high", "health"),
    ("severe_class_imbalance", "Apply SMOTE, class weighting, or undersampling",
     "Severe imbalance leads to biased predictions", "high", "health"),
    ("moderate_class_imbalance", "Consider stratified sampling or cost-sensitive learning",
     "Moderate imbalance may affect minority class performance", "medium", "health"),
    ("small_sample_size", "Collect more data or use data augmentation",
     "Small datasets lead to unreliable trust estimates", "high", "health"),
    ("many_low_variance_features", "Remove or transform low-variance features",
     "Low variance features don't contribute to predictions", "low", "health"),
    ("precision_recall_imbalance", "Adjust classification threshold or rebalance classes",
     "Imbalanced precision/recall indicates prediction bias", "medium", "performance"),
    ("low_accuracy", "Try hyperparameter tuning or feature engineering",
     "Low accuracy reduces overall trust", "high", "performance"),
    ("critical_low_accuracy", "Redesign model architecture or collect better features",
     "Critical accuracy issues make model unreliable", "critical", "performance"),
    ("low_r2_score", "Feature engineering or try different model architecture",
     "Low R² indicates poor fit to data", "high", "performance"),
    ("negative_r2_warning", "Review model and data - model performs worse than baseline",
     "Negative R² means model is worse than predicting mean", "critical", "performance"),
]
DEFAULT_RECOMMENDATION = ("Model shows good trust characteristics across all dimensions",
                          "Continue monitoring trust metrics in production", "low", "all")


def _rec(action, why, priority, component) -> Column:
    as_col = (lambda v: v if isinstance(v, Column) else F.lit(v))
    return F.struct(as_col(action).alias("action"), as_col(why).alias("why"),
                    F.lit(priority).alias("priority"), F.lit(component).alias("component"))


def _recommendations(df: DataFrame, cols: set[str]) -> DataFrame:
    """Rule recommendations + flag lookup, stably sorted by priority.

    Each entry has a fixed priority, so the stable sort equals emitting the
    candidates priority by priority in their original order."""
    fe = _c("fairness_evaluated_")
    has = (lambda f: F.array_contains(_c("flags"), f))
    rule_recs = [
        (~fe, ("Add sensitive attribute to dataset for fairness evaluation",
               "Fairness was not evaluated (F=0.5 is a neutral placeholder). "
               "Trust score may be inflated without verifying model does not discriminate.",
               "high", "fairness")),
        (_c("DII") > 0.5, ("Improve dataset quality before trusting model predictions",
                           F.format_string("High Dataset Instability Index (%.2f) indicates "
                                           "unreliable data foundation", _c("DII")),
                           "critical", "health")),
        (fe & (_c("dp_value") > 0.2), ("Apply fairness interventions (reweighting, adversarial debiasing)",
                                 F.format_string("Demographic parity difference (%.2f) exceeds "
                                                 "acceptable threshold", _c("dp_value")),
                                 "high", "fairness")),
        (fe & (_c("dp_value") > 0.1) & (_c("dp_value") <= 0.2),
         ("Monitor fairness metrics and consider bias mitigation",
          F.format_string("Mild bias detected (DP=%.2f)", _c("dp_value")), "medium", "fairness")),
        (_c("delta") > 0.2, ("Apply regularization or increase training data to reduce overfitting",
                             F.format_string("Performance degradation (%.2f) indicates overfitting",
                                             _c("delta")), "high", "robustness")),
    ]
    # flags are mutually exclusive inside each family, so flag order = table order
    flag_order = ["high_missing_values", "severe_class_imbalance", "moderate_class_imbalance",
                  "small_sample_size", "many_low_variance_features", "precision_recall_imbalance",
                  "critical_low_accuracy", "low_accuracy", "negative_r2_warning", "low_r2_score"]
    lookup = {r[0]: r[1:] for r in FLAG_RECOMMENDATIONS}
    candidates = rule_recs + [(has(f), lookup[f]) for f in flag_order]
    ordered = []
    for pr in PRIORITY_ORDER:
        for cond, rec in candidates:
            if rec[2] == pr:
                ordered.append(F.when(cond, _rec(*rec)))
    recs = F.array_compact(F.array(*ordered))
    recs = F.when(F.size(recs) == 0, F.array(_rec(*DEFAULT_RECOMMENDATION))).otherwise(recs)
    return df.withColumn("recommendations", recs.cast(f"array<{_REC}>"))


def with_gap_warning(df: DataFrame, only_mode: str | None = "balanced") -> DataFrame:
    """When trust − EvalScore > 10, append ``trust_eval_score_gap_<int>``
    to the flags and put a review recommendation first."""
    gap = _c("trust_score") - _c("eval_score")
    cols = set(df.columns)
    mae = F.coalesce(_present(cols, "mae").cast("string"), F.lit("N/A"))
    rmse = F.coalesce(_present(cols, "rmse").cast("string"), F.lit("N/A"))
    why = F.format_string(
        "Trust Score (%.1f) is significantly higher than EvalScore (%.1f). Trust Score is driven "
        "by performance metric (P=%.2f) but EvalScore penalizes raw absolute errors. MAE=%s, "
        "RMSE=%s. Verify these error magnitudes are acceptable for your use case.",
        _c("trust_score"), _c("eval_score"), round_half(_c("P"), 4), mae, rmse)
    rec = _rec("Review error magnitudes before production deployment", why, "high", "performance")
    hit = gap > 10
    if only_mode is not None:
        hit = hit & (_c("trust_mode") == only_mode)
    return (df.withColumn("trust_eval_gap", gap)
              .withColumn("flags", F.when(hit, F.concat(_c("flags"), F.array(
                  F.concat(F.lit("trust_eval_score_gap_"), F.floor(gap).cast("string")))))
                          .otherwise(_c("flags")))
              .withColumn("recommendations", F.when(hit, F.concat(
                  F.array(rec).cast(f"array<{_REC}>"), _c("recommendations")))
                          .otherwise(_c("recommendations"))))


def invariant_violations(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows whose scores, weights or trust break an invariant.

    Apply it to a materialised scored table (``plans.evaluation.score``):
    a filter directly on ``trust_columns`` output would be pushed through the
    whole expression chain by the optimizer."""
    betas = [_c(f"beta_{k}") for k in COMPONENTS]
    wsum = sum(betas, lit_d(0.0))
    in01 = (lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1))
    ok = in01(_c("P")) & in01(_c("H")) & in01(_c("F")) & in01(_c("R"))
    for b in betas:
        ok = ok & in01(b)
    ok = ok & (F.abs(wsum - 1.0) < 1e-6) & (_c("trust_score") >= 0) & (_c("trust_score") <= 100)
    ok = ok & in01(_c("DII")) & in01(_c("dp_value")) & in01(_c("delta"))
    return df.filter(~ok).select(*key_cols, "trust_mode", "P", "H", "F", "R", *betas,
                                 "trust_score", "DII", "dp_value", "delta")


def earlier_meta_score(df: DataFrame) -> DataFrame:
    """T26 (documented formula, no code in the reference): penalty-based
    health, primary metric ×100, complexity adjustment, 65/25/10 blend."""
    cols = set(df.columns)
    n = F.greatest(F.coalesce(_present(cols, "n_rows"), F.lit(1)), F.lit(1)).cast("double")
    miss = F.coalesce(_present(cols, "missing_values"), F.lit(0)) / n
    imb = F.coalesce(_present(cols, "imbalance_ratio"), lit_d(0.5))
    low = F.coalesce(_present(cols, "low_variance_fraction"), lit_d(0.0))
    pen = (F.least(miss * 100, lit_d(30.0))
           + F.when(imb > 0.6, (imb - 0.5) * 80).otherwise(lit_d(0.0))
           + F.when(n < 100, (1 - n / 100) * 20).otherwise(lit_d(0.0)) + low * 10)
    health = F.greatest(lit_d(0.0), F.least(lit_d(100.0), 100 - pen))
    mt = _c("model_type")
    primary = (F.when(mt == "classification", F.coalesce(_present(cols, "f1_score"), lit_d(0.0)) * 100)
                .when(mt == "regression", F.greatest(lit_d(0.0), F.coalesce(_present(cols, "r2_score"), lit_d(0.0))) * 100)
                .when(mt == "nlp", F.coalesce(_present(cols, "rougeL"), _present(cols, "bleu_score"), lit_d(0.0)) * 100)
                .otherwise(F.coalesce(_present(cols, "iou"), _present(cols, "dice_coefficient"), lit_d(0.0)) * 100))
    gap = F.when(mt == "classification",
                 F.abs(_present(cols, "train_f1_score") - _present(cols, "f1_score")))             .otherwise(F.abs(_present(cols, "train_r2_score") - _present(cols, "r2_score")))
    adj = F.when(F.coalesce(gap, lit_d(0.0)) > 0.1, -gap * 100 * 0.3).otherwise(lit_d(0.0))
    meta = round_half(F.greatest(lit_d(0.0), F.least(0.65 * primary + 0.25 * health + 0.10 * (100 + adj),
                                                      lit_d(100.0))), 2)
    return df.withColumn("dataset_health_score_v0", health).withColumn("meta_score_v0", meta)
