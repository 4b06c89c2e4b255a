"""Registered queries for the evaluation pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trustframe.functions.expr import round_half
from trustframe.plans import oracle as O
from trustframe.plans.catalog import register
from trustframe.plans import evaluation as E
from trustframe.plans.evaluation import evaluate_workload, flat_record, full_record
from trustframe.session import checkpoint_dir

for _wl in ("orders_status", "lineitem_price", "docs_quality", "orders_no_attributes", "orders_auto_attributes",
            "orders_multiclass"):
    def _make(wl):
        def q(spark, sf_dir):
            return flat_record(evaluate_workload(spark, sf_dir, wl))
        return q
    register(f"evaluation_{_wl}", O.evaluation_sql(_wl))(_make(_wl))


def r6(c):
    return round_half(F.col(c).cast("double"), 6).alias(c)


_NAMES = ("performance", "health", "fairness", "robustness")
# column of the flat row: (field of the record, SQL over the trust chain)
_RESULT = {"trust_score": ("trust_score", "trust_score"), "trust_score_raw": ("trust_score_raw", "trust_score_raw"), "dii": ("DII", "DII"),
           **{f"component_{n}": (f"component_scores.{n}", c) for n, c in zip(_NAMES, "PHFR")},
           **{f"dii_{k.lower()}": (f"dii_components.{k}", f"d{k}") for k in "IMDS"},
           **{f"risk_{n}": (f"risk_values.{n}", f"r_{c}") for n, c in zip(_NAMES, "PHFR")},
           **{f"weight_{n}": (f"hybrid_weights.{n}", f"beta_{n}") for n in _NAMES},
           **{f"auto_{n}": (f"beta_auto.{n}", f"fa_{n[0]} / (fa_p + fa_h + fa_f + fa_r)") for n in _NAMES},
           "lambda_value": ("lambda_value", "lambda_value"), "guard_threshold": ("guard_threshold", "tau"),
           "penalty": ("instability_penalty_value", "CASE WHEN trust_mode = 'strict' THEN 0.15::DOUBLE * DII ELSE 0.0::DOUBLE END")}


def _full_sql(wl: str, metrics: dict[str, str]) -> str:
    """``metrics``: scored metric -> its normalised value in SQL."""
    cols = [f"max(CASE WHEN trust_mode = '{m}' THEN {O.rh(f'({x})')} END) AS {p}{c}"
            for m, p in (("balanced", ""), ("strict", "strict_")) for c, (_, x) in _RESULT.items()]
    cols += [f"max(CASE WHEN trust_mode = '{m}' THEN {x} END) AS {p}{c}" for m, p in (("balanced", ""), ("strict", "strict_"))
             for c, x in (("guard_triggered", "guard_triggered"), ("verdict_status", "verdict_status"), ("trust_level", "trust_level"))]
    for c, x in metrics.items():
        cols += [f"{O.rh(f'max({c})')} AS metric_{c}", f"{O.rh(f'max({x})')} AS norm_{c}"]
    return O.materialised(O.evaluation_ctes(wl)) + "\nSELECT model_id, dataset_id, " + O.rh("max(eval_score)") + " AS eval_score, " + ", ".join(cols) + " FROM tr GROUP BY ALL"


def _flat_full(df, metrics):
    r = (lambda path, name: round_half(F.col(path).cast("double"), 6).alias(name))
    out = [r(pre + path, to + c) for pre, to in (("", ""), ("strict_result.", "strict_")) for c, (path, _) in _RESULT.items()]
    out += [F.col(pre + c).alias(to + c) for pre, to in (("", ""), ("strict_result.", "strict_"))
            for c in ("guard_triggered", "verdict_status", "trust_level")]
    for c in metrics:
        out += [r(f"metrics.{c}", f"metric_{c}"), r(f"normalized_metrics.{c}", f"norm_{c}")]
    return df.select("model_id", "dataset_id", r("eval_score", "eval_score"), *out)


_ERR = "1.0::DOUBLE / (1.0::DOUBLE + {c} / escale)"
for _wl, _ms in (("orders_status", {c: O.clip(c) for c in ("accuracy", "precision", "recall", "f1_score")}),
                 ("lineitem_price", {"r2_score": O.clip("r2_score"), "mae": O.clip(_ERR.format(c="mae")), "rmse": O.clip(_ERR.format(c="rmse"))})):
    def _make_full(wl, ms):
        def q(spark, sf_dir):
            return _flat_full(full_record(evaluate_workload(spark, sf_dir, wl)), ms)
        return q
    register(f"evaluation_full_record_{_wl}", _full_sql(_wl, _ms))(_make_full(_wl, _ms))


@register("evaluation_remainder", O.evaluation_sql("orders_status"))
def q_remainder(spark, sf_dir):
    """Two of the three models are stored; the third is evaluated and joins them."""
    wl = E.WORKLOADS["orders_status"]
    path = f"{checkpoint_dir(spark).rstrip('/')}/summaries-{uuid.uuid4().hex}"
    preds = wl.preds(spark, sf_dir)
    E.classification_summary(preds.filter(F.col("model_id") != F.lit("m_acctbal")), wl.attrs).write.parquet(path)
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in E.W.BINARY_RULES])).alias("model_id"),
                                   F.lit(wl.dataset_id).alias("dataset_id"))
    return flat_record(E.evaluate_remainder(spark, sf_dir, "orders_status", path, wanted))
