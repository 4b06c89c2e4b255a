"""Hand-written DuckDB SQL for the correctness check.

Each string runs against the pre-registered views (orders, customer, …) and
must return the same columns, rows and values as the Spark query of the same
name.  Numbers are rounded with the engine-independent ``RH(x, n)`` macro
(``sign(x) * floor(abs(x) * 10^n + 0.5) / 10^n``) on both sides.  Decimal
literals are cast to DOUBLE because DuckDB reads ``0.35`` as DECIMAL.
"""

from __future__ import annotations

import math
import re


def rh(x: str, n: int = 6) -> str:
    p = f"{10 ** n}.0::DOUBLE"
    return f"(sign({x}) * floor(abs({x}) * {p} + 0.5::DOUBLE) / {p})"


def clip(x: str, lo: str = "0.0::DOUBLE", hi: str = "1.0::DOUBLE") -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {lo} THEN {lo} WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END)"


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


# ------------------------------------------------------------------ workloads

ORDERS_DS = """
ds AS (
  SELECT o.o_orderkey AS row_id, o.o_totalprice, o.o_orderpriority, c.c_acctbal, c.c_mktsegment,
         CAST(n.n_regionkey AS VARCHAR) AS n_regionkey, o.o_orderstatus,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS target
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

BINARY_PREDS = ORDERS_DS + """,
sp AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY row_id) - 1
                      < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
  FROM ds),
preds AS (
  SELECT 'm_price' AS model_id, 'orders_status' AS dataset_id, row_id, split,
         CAST(target AS DOUBLE) AS y_true, CAST(o_totalprice > 200000 AS DOUBLE) AS y_pred,
         c_mktsegment, n_regionkey, o_orderpriority FROM sp
  UNION ALL
  SELECT 'm_priority', 'orders_status', row_id, split, CAST(target AS DOUBLE),
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE),
         c_mktsegment, n_regionkey, o_orderpriority FROM sp
  UNION ALL
  SELECT 'm_acctbal', 'orders_status', row_id, split, CAST(target AS DOUBLE),
         CAST(c_acctbal > 5000 AS DOUBLE), c_mktsegment, n_regionkey, o_orderpriority FROM sp)"""

MULTICLASS_PREDS = ORDERS_DS + """,
preds AS (
  SELECT 'mc_price' AS model_id, 'orders_status_mc' AS dataset_id, row_id, o_orderstatus AS y_true,
         CASE WHEN o_totalprice < 166800 THEN 'F' WHEN o_totalprice < 334700 THEN 'O' ELSE 'P' END AS y_pred,
         c_mktsegment, n_regionkey, o_orderpriority FROM ds
  UNION ALL
  SELECT 'mc_priority', 'orders_status_mc', row_id, o_orderstatus,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'O' ELSE 'P' END,
         c_mktsegment, n_regionkey, o_orderpriority FROM ds)"""

MULTICLASS_SPLIT_PREDS = ORDERS_DS + BINARY_PREDS[len(ORDERS_DS):BINARY_PREDS.index("preds AS")] + MULTICLASS_PREDS[
    len(ORDERS_DS) + 1:].replace("row_id, o_orderstatus", "row_id, split, o_orderstatus").replace("FROM ds", "FROM sp")

LINE_DS = """
ds AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity,
         l.l_discount, l.l_tax, p.p_size, p.p_retailprice, l.l_returnflag, l.l_linestatus,
         l.l_extendedprice
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

REGRESSION_PREDS = LINE_DS + """,
sp AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                                  l_shipdate, l_extendedprice, l_quantity) - 1
                      < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
  FROM ds),
preds AS (
  SELECT 'r_qty_price' AS model_id, 'lineitem_price' AS dataset_id, split, l_extendedprice AS y_true,
         l_quantity * p_retailprice AS y_pred, l_returnflag, l_linestatus FROM sp
  UNION ALL
  SELECT 'r_damped', 'lineitem_price', split, l_extendedprice, 0.5::DOUBLE * l_quantity * p_retailprice,
         l_returnflag, l_linestatus FROM sp
  UNION ALL
  SELECT 'r_fit', 'lineitem_price', split, l_extendedprice,
         l_extendedprice * (0.9::DOUBLE + 0.01::DOUBLE * (l_linenumber % 20)), l_returnflag, l_linestatus
  FROM sp)"""

DOCS_DS = """
ds AS (
  SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

DOCS_PREDS = DOCS_DS + """,
sp AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1
                      < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
  FROM ds),
preds AS (
  SELECT 'd_len' AS model_id, 'docs_quality' AS dataset_id, doc_id AS row_id, split,
         CAST(quality AS DOUBLE) AS y_true,
         CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred, lang, source FROM sp
  UNION ALL
  SELECT 'd_lang', 'docs_quality', doc_id, split, CAST(quality AS DOUBLE),
         CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, lang, source FROM sp)"""


# ------------------------------------------------------------------- metrics

def class_metrics_sql(src: str, name: str, where: str = "TRUE", prefix: str = "") -> str:
    """A1 over relation ``src`` → CTE ``name``."""
    return f"""
{name}_conf AS (
  SELECT model_id, dataset_id, y_true, y_pred, count(*) AS n FROM {src}
  WHERE {where} AND y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL),
{name}_pc AS (
  SELECT model_id, dataset_id, cls, sum(support) AS support, sum(tp) AS tp, sum(predicted) AS predicted
  FROM (SELECT model_id, dataset_id, CAST(y_true AS VARCHAR) AS cls, n AS support,
               CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS predicted FROM {name}_conf
        UNION ALL
        SELECT model_id, dataset_id, CAST(y_pred AS VARCHAR), 0, 0, n FROM {name}_conf) u
  GROUP BY ALL),
{name} AS (
  SELECT model_id, dataset_id, CAST(sum(support) AS BIGINT) AS {prefix}n_rows,
         sum(tp)::DOUBLE / sum(support) AS {prefix}accuracy,
         sum(support * CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0::DOUBLE END)
             / sum(support) AS {prefix}precision,
         sum(support * CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END)
             / sum(support) AS {prefix}recall,
         sum(support * CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted)
                            ELSE 0.0::DOUBLE END) / sum(support) AS {prefix}f1_score
  FROM {name}_pc GROUP BY ALL)"""


def reg_metrics_sql(src: str, name: str, where: str = "TRUE", prefix: str = "") -> str:
    return f"""
{name} AS (
  SELECT model_id, dataset_id, count(*) AS {prefix}n_rows,
         avg(abs(y_pred - y_true)) AS {prefix}mae, avg((y_pred - y_true) * (y_pred - y_true)) AS {prefix}mse,
         sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS {prefix}rmse,
         CASE WHEN var_pop(y_true) * count(*) > 0
              THEN 1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(*))
              WHEN sum((y_pred - y_true) * (y_pred - y_true)) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
             AS {prefix}r2_score,
         stddev_pop(y_true) AS {prefix}std_y, max(y_true) - min(y_true) AS {prefix}range_y
  FROM {src} WHERE {where} GROUP BY ALL)"""


# ------------------------------------------------------------------ fairness

def unpivot_sql(src: str, attrs: list[str], cols: str, where: str = "TRUE") -> str:
    parts = [f"SELECT {cols}, '{a}' AS attr, {i} AS attr_ord, CAST({a} AS VARCHAR) AS grp FROM {src} WHERE {where}"
             for i, a in enumerate(attrs)]
    return "\n  UNION ALL\n  ".join(parts)


def class_fairness_sql(src: str, attrs: list[str], where: str = "TRUE") -> str:
    """A5/A6/A7 → CTEs gm (group metrics) and gaps (per attribute)."""
    return f"""
gl AS (
  {unpivot_sql(src, attrs, "model_id, dataset_id, y_true, y_pred", where)}),
gc AS (
  SELECT model_id, dataset_id, attr, attr_ord, grp, count(*) AS n,
         count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
         count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS fp,
         count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS tn,
         count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS fn,
         count(*) FILTER (WHERE y_true = y_pred) AS correct
  FROM gl GROUP BY ALL),
gm AS (
  SELECT *, CASE WHEN n > 0 THEN correct::DOUBLE / n ELSE 0.0::DOUBLE END AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1_score,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS tpr,
         CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0.0::DOUBLE END AS fpr,
         CASE WHEN n > 0 THEN (tp + fp)::DOUBLE / n ELSE 0.0::DOUBLE END AS ppr
  FROM gc),
ga AS (
  SELECT model_id, dataset_id, attr, attr_ord, count(*) AS num_groups,
         max(ppr) - min(ppr) AS dpr, max(tpr) - min(tpr) AS eor, max(fpr) - min(fpr) AS fprr,
         max(precision) - min(precision) AS ppd,
         min(ppr) FILTER (WHERE ppr > 0) AS min_pos, max(ppr) AS max_ppr,
         count(*) FILTER (WHERE ppr > 0) AS n_pos
  FROM gm WHERE grp IS NOT NULL GROUP BY ALL),
gaps AS (
  SELECT model_id, dataset_id, attr, attr_ord, num_groups, num_groups >= 2 AS analysis_successful,
         {clip('dpr')} AS demographic_parity_difference,
         {clip('1 - ' + clip('dpr'))} AS fairness_score_F,
         {clip('eor')} AS equal_opportunity_difference,
         CASE WHEN n_pos >= 2 THEN min_pos / max_ppr ELSE 1.0::DOUBLE END AS disparate_impact_ratio,
         greatest(0.0::DOUBLE, 1 - {clip('dpr')}) AS statistical_parity,
         greatest(0.0::DOUBLE, 1 - ppd) AS predictive_parity,
         {clip('greatest(eor, fprr)')} AS equalized_odds_difference
  FROM ga),
gaps2 AS (
  SELECT *, ((1 - least(demographic_parity_difference, 1.0::DOUBLE))
             + (1 - least(equal_opportunity_difference, 1.0::DOUBLE))
             + (1 - least(equalized_odds_difference, 1.0::DOUBLE))
             + (1 - least(abs(disparate_impact_ratio - 1), 1.0::DOUBLE))
             + statistical_parity + predictive_parity) / 6.0::DOUBLE AS overall_fairness_score
  FROM gaps)"""


def reg_fairness_sql(src: str, attrs: list[str], where: str = "TRUE") -> str:
    return f"""
gl AS (
  {unpivot_sql(src, attrs, "model_id, dataset_id, y_true, y_pred", where)}),
gs AS (
  SELECT model_id, dataset_id, attr, attr_ord, grp, count(*) AS sample_count,
         avg(y_pred) AS mean_prediction, avg(y_true) AS mean_actual,
         avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
         min(y_pred) AS min_pred, max(y_pred) AS max_pred
  FROM gl GROUP BY ALL),
ga AS (
  SELECT model_id, dataset_id, attr, attr_ord, count(*) AS num_groups,
         max(mean_prediction) - min(mean_prediction) AS max_prediction_gap,
         max(mae) - min(mae) AS max_mae_gap, max(max_pred) - min(min_pred) AS pred_range,
         avg(mae) AS mean_mae
  FROM gs WHERE grp IS NOT NULL GROUP BY ALL),
gaps2 AS (
  SELECT model_id, dataset_id, attr, attr_ord, num_groups, num_groups >= 2 AS analysis_successful,
         least(1.0::DOUBLE, max_prediction_gap / greatest(pred_range, 1e-10::DOUBLE)) AS demographic_parity_difference,
         greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, max_prediction_gap / greatest(pred_range, 1e-10::DOUBLE))) AS fairness_score_F,
         least(1.0::DOUBLE, max_mae_gap / greatest(mean_mae, 1e-10::DOUBLE)) AS error_parity_difference,
         max_prediction_gap, max_mae_gap
  FROM ga),
gaps3 AS (
  SELECT *, (fairness_score_F + (1 - error_parity_difference)) / 2.0::DOUBLE AS overall_fairness_score
  FROM gaps2)"""


def fairness_summary_sql(gaps: str) -> str:
    return f"""
fs AS (
  SELECT model_id, dataset_id, count(*) AS attributes_analyzed,
         least(1.0::DOUBLE, coalesce(min(fairness_score_F) FILTER (WHERE analysis_successful), 1.0::DOUBLE))
             AS overall_fairness_score,
         arg_min(attr, attr_ord) AS primary_attribute,
         arg_min(analysis_successful, attr_ord) AS fairness_evaluated,
         nullif(arg_min(CASE WHEN analysis_successful THEN demographic_parity_difference
                             ELSE -1.0::DOUBLE END, attr_ord), -1.0::DOUBLE) AS dp
  FROM {gaps} GROUP BY ALL)"""


# ---------------------------------------------------------------- statistics

def stats_sql(src: str, dataset_id: str, cols: list[str], numeric: list[str], target: str,
              model_type: str, name: str = "st") -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    n_feat = len([c for c in cols if c != target])
    if numeric:
        lows = " + ".join(f"CASE WHEN var_samp({c}) < 0.01::DOUBLE THEN 1 ELSE 0 END" for c in numeric)
        sk = [f"(CASE WHEN count({c}) >= 3 THEN CASE WHEN var_samp({c}) = 0 THEN 0.0::DOUBLE "
              f"ELSE abs(skewness({c})) END END)" for c in numeric]
        n_ok = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN 1 ELSE 0 END" for s in sk)
        tot = " + ".join(f"coalesce({s}, 0.0::DOUBLE)" for s in sk)
        low_frac = f"({lows})::DOUBLE / {len(numeric)}"
        skew = (f"CASE WHEN ({n_ok}) = 0 THEN 1.0::DOUBLE "
                f"ELSE least(1.0::DOUBLE, ({tot}) / ({n_ok}) / 3.0::DOUBLE) END")
    else:
        low_frac, skew = "0.0::DOUBLE", "0.0::DOUBLE"
    if model_type == "classification":
        imb = (f"coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM {src} WHERE {target} IS NOT NULL "
               f"GROUP BY {target}))::DOUBLE / count(*), 0.5::DOUBLE)")
    else:
        imb = "0.5::DOUBLE"
    collist = ", ".join(cols)
    return f"""
{name} AS (
  SELECT '{dataset_id}' AS dataset_id, count(*) AS n_rows, {n_feat} AS n_features,
         CAST({nulls} AS BIGINT) AS missing_values, {imb} AS imbalance_ratio,
         (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {collist} FROM {src})))::DOUBLE
             / greatest(count(*), 1) AS duplicate_ratio,
         {skew} AS skew_score, {low_frac} AS low_variance_fraction
  FROM {src})"""


# ---------------------------------------------------------------------- trust

def trust_sql(src: str, lambda_cap: float = 0.85, user_weights: bool = False) -> str:
    """T1–T15 over relation ``src`` (one row per pair, metric columns) →
    CTE ``tr`` with one row per (pair, mode)."""
    cls = "trust_model_type = 'classification'"
    cost = (lambda v, scale: f"(CASE WHEN {v} IS NULL THEN NULL WHEN {v} >= 0 THEN "
                             f"{clip(f'1.0::DOUBLE / (1.0::DOUBLE + {v} / {scale})')} ELSE 0.0::DOUBLE END)")
    w = (lambda wt, e: f"coalesce({wt}::DOUBLE * {e}, 0.0::DOUBLE)")
    cls_sum = " + ".join(w(0.25, clip(m)) for m in ("accuracy", "precision", "recall", "f1_score"))
    reg_sum = " + ".join([w(0.4, clip("r2_score")), w(0.3, cost("mae", "escale")), w(0.3, cost("rmse", "escale"))])
    es = rh(f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * CASE model_type "
            f"WHEN 'classification' THEN {cls_sum} WHEN 'regression' THEN {reg_sum} ELSE 0.0::DOUBLE END))", 2)
    if user_weights:
        anyu = "(w_performance IS NOT NULL OR w_health IS NOT NULL OR w_fairness IS NOT NULL OR w_robustness IS NOT NULL)"
        uw = (lambda c, dflt: f"(CASE WHEN {anyu} THEN coalesce({c}, 0.25::DOUBLE) ELSE {dflt}::DOUBLE END)")
        t6 = T6_TEMPLATE.format(up=uw("w_performance", 0.40), uh=uw("w_health", 0.25), ur=uw("w_robustness", 0.15),
                                ufe=uw("w_fairness", 0.20),
                                uf=f"(CASE WHEN {anyu} THEN coalesce(w_fairness, 0.20::DOUBLE) ELSE 0.20::DOUBLE END)")
        modes = "(SELECT DISTINCT trust_mode FROM " + src + ")"
    else:
        t6 = T6_TEMPLATE.format(up="0.40::DOUBLE", uh="0.25::DOUBLE", ur="0.15::DOUBLE", ufe="0.20::DOUBLE",
                                uf="0.20::DOUBLE")
        modes = None
    body = f"""
t0 AS (
  SELECT s.*, m.trust_mode,
         CASE WHEN s.model_type = 'classification' THEN 'classification' ELSE 'regression' END AS trust_model_type,
         CASE WHEN (CASE WHEN std_y >= 1e-10::DOUBLE THEN std_y WHEN range_y > 1e-10::DOUBLE THEN range_y / 4.0::DOUBLE END) > 1e-10::DOUBLE
              THEN (CASE WHEN std_y >= 1e-10::DOUBLE THEN std_y WHEN range_y > 1e-10::DOUBLE THEN range_y / 4.0::DOUBLE END)
              ELSE 1.0::DOUBLE END AS escale
  FROM {src} s CROSS JOIN (VALUES ('balanced'), ('strict')) m(trust_mode)
  {"WHERE s.trust_mode = m.trust_mode" if user_weights else ""}),
t0b AS (
  SELECT *, {es} AS eval_score
  FROM t0),
t1 AS (
  SELECT *,
    least(1.0::DOUBLE, abs(coalesce(imbalance_ratio, 0.5::DOUBLE) - 0.5::DOUBLE) * 2.0::DOUBLE) AS dI,
    {clip('coalesce(missing_values, 0)::DOUBLE / (greatest(1, coalesce(n_rows, 1))::DOUBLE * greatest(1, coalesce(n_features, 1)))')} AS dM,
    {clip('coalesce(duplicate_ratio, 0.0::DOUBLE)')} AS dD,
    CASE WHEN coalesce(skew_score, 0.0::DOUBLE) = 0 THEN {clip('coalesce(low_variance_fraction, 0.0::DOUBLE)')}
         ELSE {clip('skew_score')} END AS dS,
    CASE WHEN {cls} THEN {clip('coalesce(f1_score, accuracy, 0.5::DOUBLE)')}
         ELSE CASE WHEN r2_score IS NOT NULL THEN {clip('greatest(0.0::DOUBLE, r2_score)')}
                   WHEN mse IS NOT NULL THEN 1.0::DOUBLE / (1.0::DOUBLE + mse) ELSE 0.5::DOUBLE END END AS P,
    coalesce(fairness_evaluated, FALSE) AS fe,
    CASE WHEN coalesce(has_train, FALSE) THEN
      (CASE WHEN abs(CASE WHEN {cls} THEN coalesce(train_f1_score, train_accuracy, 1.0::DOUBLE) ELSE coalesce(train_r2_score, 1.0::DOUBLE) END) > 1e-10::DOUBLE
            THEN abs((CASE WHEN {cls} THEN coalesce(train_f1_score, train_accuracy, 1.0::DOUBLE) ELSE coalesce(train_r2_score, 1.0::DOUBLE) END)
                     - (CASE WHEN {cls} THEN coalesce(f1_score, accuracy, 1.0::DOUBLE) ELSE coalesce(r2_score, 1.0::DOUBLE) END))
                 / abs(CASE WHEN {cls} THEN coalesce(train_f1_score, train_accuracy, 1.0::DOUBLE) ELSE coalesce(train_r2_score, 1.0::DOUBLE) END)
            ELSE abs((CASE WHEN {cls} THEN coalesce(train_f1_score, train_accuracy, 1.0::DOUBLE) ELSE coalesce(train_r2_score, 1.0::DOUBLE) END)
                     - (CASE WHEN {cls} THEN coalesce(f1_score, accuracy, 1.0::DOUBLE) ELSE coalesce(r2_score, 1.0::DOUBLE) END)) END)
    ELSE (CASE WHEN {cls} THEN abs(coalesce(precision, 0.5::DOUBLE) - coalesce(recall, 0.5::DOUBLE)) * 0.5::DOUBLE
               ELSE (1.0::DOUBLE - greatest(0.0::DOUBLE, coalesce(r2_score, 0.5::DOUBLE))) * 0.3::DOUBLE END) END AS delta_raw
  FROM t0b),
t2 AS (
  SELECT *,
    {rh(clip("CASE WHEN trust_mode = 'strict' THEN 1.0::DOUBLE - (1.0::DOUBLE - dI) * (1.0::DOUBLE - dM) * (1.0::DOUBLE - dD) * (1.0::DOUBLE - dS) ELSE 0.35::DOUBLE * dM + 0.30::DOUBLE * dI + 0.20::DOUBLE * dD + 0.15::DOUBLE * dS END"), 4)} AS DII,
    CASE WHEN fe THEN {clip('dp')} ELSE 0.5::DOUBLE END AS dp_value,
    {clip('delta_raw')} AS delta
  FROM t1),
t3 AS (
  SELECT *, {clip('1.0::DOUBLE - DII')} AS H,
         {clip('CASE WHEN fe THEN 1.0::DOUBLE - dp_value ELSE 0.5::DOUBLE END')} AS F,
         {clip('1.0::DOUBLE - delta')} AS R,
         CASE WHEN trust_mode = 'strict' THEN {clip(f"pow({clip('1.0::DOUBLE - P')}, 1.5::DOUBLE)")} ELSE {clip('1.0::DOUBLE - P')} END AS r_P,
         CASE WHEN trust_mode = 'strict' THEN {clip(f"pow({clip('DII')}, 1.5::DOUBLE)")} ELSE {clip('DII')} END AS r_H,
         CASE WHEN NOT fe THEN NULL WHEN trust_mode = 'strict' THEN {clip(f"pow({clip('dp_value')}, 1.5::DOUBLE)")} ELSE {clip('dp_value')} END AS r_F,
         CASE WHEN trust_mode = 'strict' THEN {clip(f"pow({clip('delta')}, 1.5::DOUBLE)")} ELSE {clip('delta')} END AS r_R
  FROM t2),
t4 AS (
  SELECT *, r_P + r_H + r_R + coalesce(r_F, 0.0::DOUBLE) AS risk_sum,
         CASE WHEN fe THEN 0.25::DOUBLE ELSE 1.0::DOUBLE / 3.0::DOUBLE END AS eqw
  FROM t3),
t5 AS (
  SELECT *,
    greatest(CASE WHEN risk_sum > 1e-12::DOUBLE THEN r_P / risk_sum ELSE eqw END, 0.05::DOUBLE) AS fa_p,
    greatest(CASE WHEN risk_sum > 1e-12::DOUBLE THEN r_H / risk_sum ELSE eqw END, 0.05::DOUBLE) AS fa_h,
    CASE WHEN fe THEN greatest(CASE WHEN risk_sum > 1e-12::DOUBLE THEN r_F / risk_sum ELSE eqw END, 0.05::DOUBLE) ELSE 0.0::DOUBLE END AS fa_f,
    greatest(CASE WHEN risk_sum > 1e-12::DOUBLE THEN r_R / risk_sum ELSE eqw END, 0.05::DOUBLE) AS fa_r,
    least(CASE WHEN trust_mode = 'strict' THEN {clip('pow(DII, 1.5::DOUBLE)')} ELSE DII END, {d(lambda_cap)}) AS lambda_value
  FROM t4),
{t6}t7 AS (
  SELECT *, hb_p / (hb_p + hb_h + hb_f + hb_r) AS beta_performance, hb_h / (hb_p + hb_h + hb_f + hb_r) AS beta_health,
         hb_f / (hb_p + hb_h + hb_f + hb_r) AS beta_fairness, hb_r / (hb_p + hb_h + hb_f + hb_r) AS beta_robustness
  FROM t6),
t8 AS (
  SELECT *, 100.0::DOUBLE * (beta_performance * P + beta_health * H + CASE WHEN fe THEN beta_fairness * F ELSE 0.0::DOUBLE END
                             + beta_robustness * R) AS traw,
         CASE WHEN trust_mode = 'strict' THEN 0.40::DOUBLE ELSE 0.30::DOUBLE END AS tau
  FROM t7),
t9 AS (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, traw * (1.0::DOUBLE - CASE WHEN trust_mode = 'strict' THEN 0.15::DOUBLE * DII ELSE 0.0::DOUBLE END))) AS tscore,
         (P < tau) OR (H < tau) OR (R < tau) OR (fe AND F < tau) AS guard_triggered,
         coalesce(missing_values, 0)::DOUBLE / greatest(1, coalesce(n_rows, 1) * coalesce(n_features, 1)) AS miss_f
  FROM t8),
t10 AS (
  SELECT *, concat_ws(',',
     CASE WHEN NOT fe THEN 'fairness_unverified' END,
     CASE WHEN DII > 0.7::DOUBLE THEN 'critical_dataset_instability' WHEN DII > 0.5::DOUBLE THEN 'high_dataset_instability'
          WHEN DII > 0.3::DOUBLE THEN 'moderate_dataset_instability' END,
     CASE WHEN fe AND dp_value > 0.3::DOUBLE THEN 'severe_fairness_violation' WHEN fe AND dp_value > 0.2::DOUBLE THEN 'significant_bias_detected'
          WHEN fe AND dp_value > 0.1::DOUBLE THEN 'mild_bias_detected' END,
     CASE WHEN delta > 0.3::DOUBLE THEN 'severe_overfitting' WHEN delta > 0.2::DOUBLE THEN 'significant_overfitting'
          WHEN delta > 0.1::DOUBLE THEN 'mild_overfitting' END,
     CASE WHEN miss_f > 0.1::DOUBLE THEN 'high_missing_values' END,
     CASE WHEN coalesce(imbalance_ratio, 0.5::DOUBLE) > 0.8::DOUBLE THEN 'severe_class_imbalance'
          WHEN coalesce(imbalance_ratio, 0.5::DOUBLE) > 0.7::DOUBLE THEN 'moderate_class_imbalance' END,
     CASE WHEN coalesce(n_rows, 0) < 100 THEN 'small_sample_size' END,
     CASE WHEN coalesce(low_variance_fraction, 0.0::DOUBLE) > 0.3::DOUBLE THEN 'many_low_variance_features' END,
     CASE WHEN {cls} AND abs(coalesce(precision, 0.0::DOUBLE) - coalesce(recall, 0.0::DOUBLE)) > 0.15::DOUBLE THEN 'precision_recall_imbalance' END,
     CASE WHEN {cls} AND coalesce(accuracy, 0.0::DOUBLE) < 0.6::DOUBLE THEN 'critical_low_accuracy'
          WHEN {cls} AND coalesce(accuracy, 0.0::DOUBLE) < 0.7::DOUBLE THEN 'low_accuracy' END,
     CASE WHEN NOT ({cls}) AND coalesce(r2_score, 0.0::DOUBLE) < 0 THEN 'negative_r2_warning'
          WHEN NOT ({cls}) AND coalesce(r2_score, 0.0::DOUBLE) < 0.3::DOUBLE THEN 'critical_low_r2'
          WHEN NOT ({cls}) AND coalesce(r2_score, 0.0::DOUBLE) < 0.5::DOUBLE THEN 'low_r2_score' END) AS flags0
  FROM t9),
t11 AS (
  SELECT *, (flags0 LIKE '%severe%' OR flags0 LIKE '%critical%' OR flags0 LIKE '%negative%') AS has_crit,
         {rh('tscore', 2)} AS trust_score, {rh('traw', 2)} AS trust_score_raw
  FROM t10),
tr AS (
  SELECT *,
    CASE WHEN guard_triggered THEN 'high_risk' WHEN tscore >= 85 AND NOT has_crit THEN 'high_trust'
         WHEN tscore >= 70 AND NOT has_crit THEN 'moderate_trust' WHEN tscore >= 50 THEN 'low_trust'
         ELSE 'untrusted' END AS verdict_status,
    CASE WHEN guard_triggered THEN 'critical' WHEN tscore >= 90 THEN 'excellent' WHEN tscore >= 80 THEN 'good'
         WHEN tscore >= 70 THEN 'acceptable' WHEN tscore >= 50 THEN 'questionable' ELSE 'poor' END AS trust_level,
    concat_ws(',', CASE WHEN flags0 = '' THEN NULL ELSE flags0 END,
              CASE WHEN trust_mode = 'balanced' AND trust_score - eval_score > 10
                   THEN 'trust_eval_score_gap_' || CAST(floor(trust_score - eval_score) AS BIGINT) END) AS flags,
    concat_ws(' | ',
      CASE WHEN trust_mode = 'balanced' AND trust_score - eval_score > 10 THEN 'Review error magnitudes before production deployment' END,
      {recs_sql()}) AS actions
  FROM t11)"""
    return body


T6_TEMPLATE = """t6 AS (
  SELECT *,
    lambda_value * fa_p / (fa_p + fa_h + fa_f + fa_r) + (1 - lambda_value) * (CASE WHEN fe THEN {up} ELSE {up} + {uf} / 3.0::DOUBLE END) AS hb_p,
    lambda_value * fa_h / (fa_p + fa_h + fa_f + fa_r) + (1 - lambda_value) * (CASE WHEN fe THEN {uh} ELSE {uh} + {uf} / 3.0::DOUBLE END) AS hb_h,
    CASE WHEN fe THEN lambda_value * fa_f / (fa_p + fa_h + fa_f + fa_r) + (1 - lambda_value) * {ufe} ELSE 0.0::DOUBLE END AS hb_f,
    lambda_value * fa_r / (fa_p + fa_h + fa_f + fa_r) + (1 - lambda_value) * (CASE WHEN fe THEN {ur} ELSE {ur} + {uf} / 3.0::DOUBLE END) AS hb_r
  FROM t5),
"""


def recs_sql() -> str:
    """Recommendation actions in priority order (critical, high, medium, low);
    falls back to the 'good' entry when nothing applies."""
    has = (lambda f: f"(',' || flags0 || ',') LIKE '%,{f},%'")
    items = [
        ("NOT fe", "Add sensitive attribute to dataset for fairness evaluation", "high"),
        ("DII > 0.5::DOUBLE", "Improve dataset quality before trusting model predictions", "critical"),
        ("fe AND dp_value > 0.2::DOUBLE", "Apply fairness interventions (reweighting, adversarial debiasing)", "high"),
        ("fe AND dp_value > 0.1::DOUBLE AND dp_value <= 0.2::DOUBLE", "Monitor fairness metrics and consider bias mitigation", "medium"),
        ("delta > 0.2::DOUBLE", "Apply regularization or increase training data to reduce overfitting", "high"),
        (has("high_missing_values"), "Handle missing values with imputation or removal", "high"),
        (has("severe_class_imbalance"), "Apply SMOTE, class weighting, or undersampling", "high"),
        (has("moderate_class_imbalance"), "Consider stratified sampling or cost-sensitive learning", "medium"),
        (has("small_sample_size"), "Collect more data or use data augmentation", "high"),
        (has("many_low_variance_features"), "Remove or transform low-variance features", "low"),
        (has("precision_recall_imbalance"), "Adjust classification threshold or rebalance classes", "medium"),
        (has("critical_low_accuracy"), "Redesign model architecture or collect better features", "critical"),
        (has("low_accuracy"), "Try hyperparameter tuning or feature engineering", "high"),
        (has("negative_r2_warning"), "Review model and data - model performs worse than baseline", "critical"),
        (has("low_r2_score"), "Feature engineering or try different model architecture", "high"),
    ]
    ordered = [(c, a) for p in ("critical", "high", "medium", "low") for c, a, pr in items if pr == p]
    body = ", ".join(f"CASE WHEN {c} THEN '{a}' END" for c, a in ordered)
    return (f"coalesce(nullif(concat_ws(' | ', {body}), ''), "
            f"'Model shows good trust characteristics across all dimensions')")


def flat_record_sql() -> str:
    cols = ["eval_score", "trust_score", "trust_score_raw", "DII", "P", "H", "F", "R", "lambda_value",
            "beta_performance", "beta_health", "beta_fairness", "beta_robustness"]
    return ("SELECT model_id, dataset_id, trust_mode, "
            + ", ".join(f"{rh(c)} AS {c}" for c in cols)
            + ", guard_triggered, verdict_status, trust_level, flags, actions FROM tr")


def evaluation_sql(workload: str) -> str:
    """Oracle for ``plans.evaluation.evaluate_workload`` + ``flat_record``."""
    return evaluation_ctes(workload) + "\n" + flat_record_sql()


def lambda_sensitivity_sql(workload: str) -> str:
    """Oracle for T18 on top of the trust CTE chain (uses t3's components)."""
    return lambda_sensitivity_ctes(workload) + f"""
SELECT model_id, dataset_id, trust_mode, exponent, {rh('lam', 4)} AS lambda_value, {rh('t', 2)} AS trust_score,
       {rh(rh('t', 2) + ' - ' + rh('first_value(t) OVER (PARTITION BY model_id, dataset_id, trust_mode ORDER BY exponent)', 2), 2)} AS vs_baseline
FROM ls4"""


def lambda_summary_sql(workload: str) -> str:
    return lambda_sensitivity_ctes(workload) + f"""
SELECT model_id, dataset_id, trust_mode, {rh('max(t) - min(t)', 2)} AS score_range, {rh('stddev_pop(t)', 4)} AS score_std,
       {rh('CASE WHEN avg(t) > 0 THEN stddev_pop(t) / avg(t) ELSE 0.0::DOUBLE END', 4)} AS coefficient_of_variation,
       {rh('min(t)', 2)} AS min_score, {rh('max(t)', 2)} AS max_score
FROM ls4 GROUP BY model_id, dataset_id, trust_mode"""


def lambda_sensitivity_ctes(workload: str) -> str:
    amp = (lambda r: f"CASE WHEN trust_mode = 'strict' THEN {clip(f'pow({r}, 1.5::DOUBLE)')} ELSE {r} END")
    return evaluation_ctes(workload) + f""",
ls AS (
  SELECT model_id, dataset_id, trust_mode, P, H, F, R, DII, e.exponent,
         least({clip('pow(DII, e.exponent)')}, 0.85::DOUBLE) AS lam,
         {amp(clip('1 - P'))} AS rp, {amp(clip('DII'))} AS rhh, {amp(clip('dp_value'))} AS rf, {amp(clip('delta'))} AS rr
  FROM t3 CROSS JOIN (VALUES (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) e(exponent)),
ls2 AS (SELECT *, rp + rhh + rf + rr AS s FROM ls),
ls3 AS (
  SELECT *, lam * CASE WHEN s > 1e-12::DOUBLE THEN rp / s ELSE 0.25::DOUBLE END + (1 - lam) * 0.4::DOUBLE AS hp,
         lam * CASE WHEN s > 1e-12::DOUBLE THEN rhh / s ELSE 0.25::DOUBLE END + (1 - lam) * 0.25::DOUBLE AS hh,
         lam * CASE WHEN s > 1e-12::DOUBLE THEN rf / s ELSE 0.25::DOUBLE END + (1 - lam) * 0.2::DOUBLE AS hf,
         lam * CASE WHEN s > 1e-12::DOUBLE THEN rr / s ELSE 0.25::DOUBLE END + (1 - lam) * 0.15::DOUBLE AS hr
  FROM ls2),
ls4 AS (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (hp / (hp + hh + hf + hr) * P
         + hh / (hp + hh + hf + hr) * H + hf / (hp + hh + hf + hr) * F + hr / (hp + hh + hf + hr) * R)
         * (1 - CASE WHEN trust_mode = 'strict' THEN 0.15::DOUBLE * DII ELSE 0.0::DOUBLE END))) AS t
  FROM ls3)"""


NO_FAIRNESS = """
fs AS (SELECT '' AS model_id, '' AS dataset_id, FALSE AS fairness_evaluated, 0.0::DOUBLE AS dp WHERE FALSE)"""


def evaluation_ctes(workload: str) -> str:
    if workload in ("orders_status", "orders_no_attributes", "orders_auto_attributes"):
        preds, attrs, mt = BINARY_PREDS, ["c_mktsegment", "n_regionkey", "o_orderpriority"], "classification"
        if workload == "orders_no_attributes":
            attrs = []
        elif workload == "orders_auto_attributes":  # in column order
            attrs = ["o_orderpriority", "c_mktsegment", "n_regionkey"]
        st = stats_sql("ds2", "orders_status",
                       ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey", "target"],
                       ["o_totalprice", "c_acctbal"], "target", mt)
        ds2 = "ds2 AS (SELECT o_totalprice, o_orderpriority, c_acctbal, c_mktsegment, n_regionkey, target FROM ds)"
    elif workload == "orders_multiclass":
        preds, attrs, mt = MULTICLASS_SPLIT_PREDS, [], "classification"  # labels aren't 0/1: no rates
        cols = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey", "o_orderstatus"]
        st = stats_sql("ds2", "orders_status_mc", cols, ["o_totalprice", "c_acctbal"], "o_orderstatus", mt)
        ds2 = "ds2 AS (SELECT " + ", ".join(cols) + " FROM ds)"
    elif workload == "docs_quality":
        preds, attrs, mt = DOCS_PREDS, ["lang", "source"], "classification"
        st = stats_sql("ds2", "docs_quality", ["n_chars", "lang", "source", "quality"], ["n_chars"],
                       "quality", mt)
        ds2 = "ds2 AS (SELECT n_chars, lang, source, quality FROM ds)"
    else:
        preds, attrs, mt = REGRESSION_PREDS, ["l_returnflag", "l_linestatus"], "regression"
        cols = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "l_returnflag",
                "l_linestatus", "l_extendedprice"]
        st = stats_sql("ds2", "lineitem_price", cols,
                       ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"], "l_extendedprice", mt)
        ds2 = "ds2 AS (SELECT " + ", ".join(cols) + " FROM ds)"
    if mt == "classification":
        parts = (class_metrics_sql("preds", "met") + ","
                 + class_metrics_sql("preds", "trn", "split = 'train'", "train_") + ","
                 + (class_fairness_sql("preds", attrs, "split = 'test'") + ","
                    + fairness_summary_sql("gaps2") if attrs else NO_FAIRNESS))
        train_cols = "trn.train_accuracy, trn.train_f1_score, NULL::DOUBLE AS train_r2_score"
        extra = ("NULL::DOUBLE AS mae, NULL::DOUBLE AS mse, NULL::DOUBLE AS rmse, NULL::DOUBLE AS r2_score, "
                 "NULL::DOUBLE AS std_y, NULL::DOUBLE AS range_y")
        metcols = "met.accuracy, met.precision, met.recall, met.f1_score"
    else:
        parts = (reg_metrics_sql("preds", "met") + ","
                 + reg_metrics_sql("preds", "trn", "split = 'train'", "train_") + ","
                 + reg_fairness_sql("preds", attrs, "split = 'test'") + ","
                 + fairness_summary_sql("gaps3"))
        train_cols = "NULL::DOUBLE AS train_accuracy, NULL::DOUBLE AS train_f1_score, trn.train_r2_score"
        extra = "met.mae, met.mse, met.rmse, met.r2_score, met.std_y, met.range_y"
        metcols = ("NULL::DOUBLE AS accuracy, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, "
                   "NULL::DOUBLE AS f1_score")
    inputs = f"""
inp AS (
  SELECT met.model_id, met.dataset_id, '{mt}' AS model_type, {metcols}, {extra}, {train_cols},
         TRUE AS has_train, coalesce(fs.fairness_evaluated, FALSE) AS fairness_evaluated, fs.dp,
         st.n_rows, st.n_features, st.missing_values, st.imbalance_ratio, st.duplicate_ratio,
         st.skew_score, st.low_variance_fraction
  FROM met LEFT JOIN trn USING (model_id, dataset_id) LEFT JOIN fs USING (model_id, dataset_id)
  LEFT JOIN st ON st.dataset_id = met.dataset_id)"""
    return ("WITH " + preds + ",\n" + ds2 + ",\n" + st + ",\n" + parts + ",\n" + inputs + ",\n"
            + trust_sql("inp"))


def fold_results_sql(k: int = 5) -> str:
    """Oracle for ``experiment.fold_results``: stratified folds by md5(row_id),
    per-fold test metrics and DP, training-part statistics, trust both modes."""
    feats = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey"]
    num = ["o_totalprice", "c_acctbal"]
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in feats)
    sk = " + ".join(f"abs(coalesce(skewness({c}), 0.0::DOUBLE))" for c in num)
    folds_list = ", ".join(f"({i})" for i in range(k))
    return "WITH " + ORDERS_DS + f""",
fd AS (SELECT *, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) - 1) % {k} AS INTEGER) AS fold FROM ds),
preds AS (
  SELECT 'm_price' AS model_id, fold, target, CAST(o_totalprice > 200000 AS DOUBLE) AS y_pred, c_mktsegment FROM fd
  UNION ALL SELECT 'm_priority', fold, target, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS DOUBLE), c_mktsegment FROM fd
  UNION ALL SELECT 'm_acctbal', fold, target, CAST(c_acctbal > 5000 AS DOUBLE), c_mktsegment FROM fd),
m AS (SELECT model_id, fold, avg(CASE WHEN target = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy,
             CASE WHEN count(*) FILTER (WHERE y_pred = 1) + count(*) FILTER (WHERE target = 1) > 0
                  THEN 2.0::DOUBLE * count(*) FILTER (WHERE target = 1 AND y_pred = 1)
                       / (count(*) FILTER (WHERE y_pred = 1) + count(*) FILTER (WHERE target = 1)) ELSE 0.0::DOUBLE END AS f1_score
      FROM preds GROUP BY ALL),
rt AS (SELECT model_id, fold, c_mktsegment, avg(y_pred) AS r FROM preds GROUP BY ALL),
dpt AS (SELECT model_id, fold, abs(max(r) - min(r)) AS dp FROM rt GROUP BY ALL),
tf AS (SELECT f.f AS tfold, fd.* FROM fd JOIN (VALUES {folds_list}) f(f) ON fd.fold <> f.f),
st AS (SELECT tfold AS fold, count(*) AS n_rows, {len(feats)} AS n_features, CAST({miss} AS BIGINT) AS missing_values,
              tanh(({sk}) / {len(num)}.0::DOUBLE / 3.0::DOUBLE) AS skew_score FROM tf GROUP BY tfold),
dup AS (SELECT tfold AS fold, sum(c - 1) AS dups FROM (SELECT tfold, {", ".join(feats)}, count(*) AS c FROM tf GROUP BY ALL) GROUP BY tfold),
cls AS (SELECT tfold AS fold, min(c)::DOUBLE / max(c) AS imbalance_ratio FROM (SELECT tfold, target, count(*) AS c FROM tf GROUP BY ALL) GROUP BY tfold),
inp AS (
  SELECT m.model_id, 'orders_status' AS dataset_id, m.fold, 'classification' AS model_type, m.accuracy,
         NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, m.f1_score, NULL::DOUBLE AS mae, NULL::DOUBLE AS mse,
         NULL::DOUBLE AS rmse, NULL::DOUBLE AS r2_score, NULL::DOUBLE AS std_y, NULL::DOUBLE AS range_y,
         NULL::DOUBLE AS train_accuracy, NULL::DOUBLE AS train_f1_score, NULL::DOUBLE AS train_r2_score,
         FALSE AS has_train, TRUE AS fairness_evaluated, dpt.dp, st.n_rows, st.n_features, st.missing_values,
         cls.imbalance_ratio, dup.dups::DOUBLE / st.n_rows AS duplicate_ratio, st.skew_score,
         NULL::DOUBLE AS low_variance_fraction
  FROM m JOIN dpt USING (model_id, fold) JOIN st USING (fold) JOIN dup USING (fold) JOIN cls USING (fold)),
""" + trust_sql("inp")[1:] + f""",
fr AS (SELECT model_id, fold, accuracy, f1_score, dp,
              max(CASE WHEN trust_mode = 'balanced' THEN trust_score END) AS trust_balanced,
              max(CASE WHEN trust_mode = 'strict' THEN trust_score END) AS trust_strict
       FROM tr GROUP BY model_id, fold, accuracy, f1_score, dp)"""


def fairness_weight_sweep_sql(weights: list[float]) -> str:
    """Oracle for ``experiment.fairness_weight_sweep`` (T19 + K8)."""
    full = fold_results_sql()
    head = full[:full.index("tf AS (")].rstrip().rstrip(",")
    feats = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey"]
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in feats)
    wv = ", ".join(f"({w!r}::DOUBLE)" for w in weights)
    return head + f""",
pm AS (SELECT m.model_id, avg(m.accuracy) AS accuracy, avg(m.f1_score) AS f1_score, avg(dpt.dp) AS dp
       FROM m JOIN dpt USING (model_id, fold) GROUP BY m.model_id),
fst AS (SELECT count(*) AS n_rows, CAST({miss} AS BIGINT) AS missing_values,
               tanh((abs(coalesce(skewness(o_totalprice), 0.0::DOUBLE)) + abs(coalesce(skewness(c_acctbal), 0.0::DOUBLE)))
                    / 2.0::DOUBLE / 3.0::DOUBLE) AS skew_score FROM ds),
fdu AS (SELECT sum(c - 1) AS dups FROM (SELECT {", ".join(feats)}, count(*) AS c FROM ds GROUP BY ALL)),
fcl AS (SELECT min(c)::DOUBLE / max(c) AS imbalance_ratio FROM (SELECT target, count(*) AS c FROM ds GROUP BY target)),
grid AS (
  SELECT pm.model_id, 'orders_status' AS dataset_id, w.w_f, md.trust_mode, 'classification' AS model_type,
         pm.accuracy, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, pm.f1_score, NULL::DOUBLE AS mae,
         NULL::DOUBLE AS mse, NULL::DOUBLE AS rmse, NULL::DOUBLE AS r2_score, NULL::DOUBLE AS std_y,
         NULL::DOUBLE AS range_y, NULL::DOUBLE AS train_accuracy, NULL::DOUBLE AS train_f1_score,
         NULL::DOUBLE AS train_r2_score, FALSE AS has_train, TRUE AS fairness_evaluated, pm.dp,
         fst.n_rows, 5 AS n_features, fst.missing_values, fcl.imbalance_ratio,
         fdu.dups::DOUBLE / fst.n_rows AS duplicate_ratio, fst.skew_score, NULL::DOUBLE AS low_variance_fraction,
         0.40::DOUBLE * (CASE WHEN 1 - w.w_f > 0 THEN (1 - w.w_f) / 0.80::DOUBLE ELSE 0.0::DOUBLE END) AS w_performance,
         0.25::DOUBLE * (CASE WHEN 1 - w.w_f > 0 THEN (1 - w.w_f) / 0.80::DOUBLE ELSE 0.0::DOUBLE END) AS w_health,
         w.w_f AS w_fairness,
         0.15::DOUBLE * (CASE WHEN 1 - w.w_f > 0 THEN (1 - w.w_f) / 0.80::DOUBLE ELSE 0.0::DOUBLE END) AS w_robustness
  FROM pm, fst, fdu, fcl, (VALUES {wv}) w(w_f), (VALUES ('balanced'), ('strict')) md(trust_mode)),
""" + trust_sql("grid", user_weights=True)[1:] + """,
sw AS (SELECT model_id, trust_mode, w_f, trust_score,
              coalesce(trust_score - lag(trust_score) OVER (PARTITION BY model_id, trust_mode ORDER BY w_f), 0.0::DOUBLE) AS delta
       FROM tr)"""


# Fixed value: the 97.5 % point of Student's t with 9 degrees of freedom (10 runs).
T_975_9 = "2.2621571628540993::DOUBLE"


def materialised(sql: str) -> str:
    """The long chains' steps computed once each: inlined, their expressions multiply."""
    return re.sub(r"\b(inp|rep|rp0|sd|sst|preds|q?t[3689]|q?tr|ci|bm) AS \(", r"\1 AS MATERIALIZED (", sql)


def replicate_sql(src: str, keys: str = "model_id, dataset_id", sigma: float = 0.02) -> str:
    """T17 + K6 after ``trust_sql``: ten re-scorings of each (pair, mode) of ``src`` with the same MD5 draws
    -> CTE ``ci``.  Columns of a classification pair are perturbed."""
    def u(name: str, half: str) -> str:
        return (f"(('0x' || substr(md5(model_id || '|' || dataset_id || '|' || trust_mode || '|' || run::VARCHAR || '|{name}|{half}'), 1, 8))"
                f"::BIGINT / 4294967296.0::DOUBLE)")

    def z(name: str) -> str:
        return (f"{d(sigma)} * (sqrt(-2.0::DOUBLE * ln(greatest({u(name, 'a')}, 1e-12::DOUBLE)))"
                f" * cos({2 * math.pi!r}::DOUBLE * {u(name, 'b')}))")
    noisy = [f"{clip(f'{c} + {z(c)}')} AS {c}" for c in
             ("accuracy", "f1_score", "precision", "recall", "train_accuracy", "train_f1_score", "imbalance_ratio", "duplicate_ratio")]
    noisy.append(f"CASE WHEN fairness_evaluated AND dp IS NOT NULL THEN {clip(f'abs(dp) + ' + z('dp'))} ELSE dp END AS dp")
    kept = ["std_y", "range_y", "model_type", "mae", "mse", "rmse", "r2_score", "train_r2_score", "has_train", "fairness_evaluated",
            "n_rows", "n_features", "missing_values", "skew_score", "low_variance_fraction"]
    nulls = ", ".join(f"NULL::DOUBLE AS w_{c}" for c in ("performance", "health", "fairness", "robustness"))
    chain = trust_sql("rep", user_weights=True)
    for name in ("t0b", "t0", "t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9", "t10", "t11", "tr"):
        chain = re.sub(rf"\b{name}\b", f"q{name}", chain)
    return f"""
rp0 AS (SELECT s.*, m.trust_mode, g.run FROM {src} s CROSS JOIN (VALUES ('balanced'), ('strict')) m(trust_mode),
        generate_series(0, 9) g(run)),
rep AS (SELECT model_id, dataset_id, trust_mode, run, {nulls}, {", ".join(kept)}, {", ".join(noisy)} FROM rp0),
{chain.lstrip()},
ci0 AS (SELECT {keys}, trust_mode, count(*) AS n_runs, avg(trust_score) AS mean, stddev_samp(trust_score) AS std,
               list_sort(list(trust_score))[6] AS median_run_trust FROM qtr GROUP BY ALL),
ci1 AS (SELECT *, CASE WHEN std > 0 THEN {T_975_9} * std / sqrt(n_runs) ELSE 0.0::DOUBLE END AS m FROM ci0),
ci AS (SELECT {keys}, trust_mode, n_runs, {rh('mean', 2)} AS trust_score_mean, {rh('std', 4)} AS std_trust,
              {rh('m', 4)} AS confidence_interval, {rh('greatest(0.0::DOUBLE, mean - m)', 2)} AS lower_bound,
              {rh('least(100.0::DOUBLE, mean + m)', 2)} AS upper_bound, median_run_trust FROM ci1)"""


def scenario_table_sql(biased_value: str) -> str:
    """Oracle for ``experiment.scenario_table`` (M8)."""
    feats = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey"]
    num = ["o_totalprice", "c_acctbal"]
    u = (lambda key: f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)")
    lost = ", ".join((f"CASE WHEN {u(f"'42|' || CAST(row_id AS VARCHAR) || '|{c}'")} < p THEN NULL ELSE {c} END AS {c}"
                      if c != "c_mktsegment" else c) for c in feats)
    rules = [("m_price", "o_totalprice > 200000"), ("m_priority", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
             ("m_acctbal", "c_acctbal > 5000")]
    preds = "\n  UNION ALL ".join(
        f"SELECT '{m}' AS model_id, scenario AS dataset_id, row_id, copy, CAST(target AS DOUBLE) AS y_true, "
        f"coalesce(CAST(({r}) AS DOUBLE), 0.0::DOUBLE) AS y_pred, c_mktsegment FROM sd" for m, r in rules)
    sk = [f"(CASE WHEN count({c}) >= 3 THEN CASE WHEN var_samp({c}) = 0 THEN 0.0::DOUBLE ELSE abs(skewness({c})) END END)" for c in num]
    cols = ", ".join([*feats, "target"])
    return "WITH " + ORDERS_DS + f""",
inj AS (SELECT v.name AS scenario, row_id, {lost}, target
        FROM ds, (VALUES ('clean', 0.0::DOUBLE), ('moderate', 0.10::DOUBLE), ('severe', 0.30::DOUBLE)) v(name, p)),
mj AS (SELECT target, count(*) AS n FROM ds GROUP BY target ORDER BY n DESC, target LIMIT 1),
pos AS (SELECT inj.*, row_number() OVER (ORDER BY row_id) - 1 AS p FROM inj JOIN mj USING (target) WHERE scenario = 'severe'),
dr AS (SELECT g.d, CAST(floor({u("'42|' || CAST(g.d AS VARCHAR)")} * mj.n) AS BIGINT) AS p
       FROM mj, generate_series(0, CAST(floor(mj.n * 0.2::DOUBLE) AS BIGINT) - 1) g(d)),
sd AS (SELECT scenario, row_id, -1 AS copy, {cols} FROM inj
       UNION ALL SELECT scenario, row_id, d, {cols} FROM dr JOIN pos USING (p)),
pr0 AS ({preds}),
pr1 AS (SELECT * FROM pr0
        UNION ALL SELECT model_id, 'strong', row_id, copy, y_true, CASE WHEN c_mktsegment = '{biased_value}' THEN 1.0::DOUBLE ELSE y_pred END,
               c_mktsegment FROM pr0 WHERE dataset_id = 'clean'
        UNION ALL SELECT model_id, 'extreme', row_id, copy, y_true, CASE WHEN c_mktsegment = '{biased_value}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
               c_mktsegment FROM pr0 WHERE dataset_id = 'clean'),
preds AS (SELECT * FROM pr1 WHERE {u("'test|' || CAST(row_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)")} < 0.3::DOUBLE),""" \
        + class_metrics_sql("preds", "met") + "," + class_fairness_sql("preds", ["c_mktsegment"]) + "," + fairness_summary_sql("gaps2") + f""",
sb AS (SELECT scenario, count(*) AS n_rows, CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in [*feats, "target"])} AS BIGINT) AS missing_values,
              ({" + ".join(f"CASE WHEN var_samp({c}) < 0.01::DOUBLE THEN 1 ELSE 0 END" for c in num)})::DOUBLE / {len(num)} AS low_variance_fraction,
              coalesce(tanh(({" + ".join(f"coalesce({x}, 0.0::DOUBLE)" for x in sk)}) / ({" + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in sk)}) / 3.0::DOUBLE), 0.0::DOUBLE) AS skew_score
       FROM sd GROUP BY scenario),
sk AS (SELECT scenario, min(c)::DOUBLE / max(c) AS imbalance_ratio FROM (SELECT scenario, target, count(*) AS c FROM sd WHERE target IS NOT NULL GROUP BY ALL) GROUP BY scenario),
su AS (SELECT scenario, count(*) AS nd FROM (SELECT DISTINCT scenario, {cols} FROM sd) GROUP BY scenario),
sst AS (SELECT * FROM sb JOIN sk USING (scenario) JOIN su USING (scenario)),
inp AS (
  SELECT met.model_id, met.dataset_id, 'classification' AS model_type, met.accuracy, met.precision, met.recall, met.f1_score,
         NULL::DOUBLE AS mae, NULL::DOUBLE AS mse, NULL::DOUBLE AS rmse, NULL::DOUBLE AS r2_score, NULL::DOUBLE AS std_y,
         NULL::DOUBLE AS range_y, NULL::DOUBLE AS train_accuracy, NULL::DOUBLE AS train_f1_score, NULL::DOUBLE AS train_r2_score,
         FALSE AS has_train, coalesce(fs.fairness_evaluated, FALSE) AS fairness_evaluated, fs.dp, sst.n_rows, {len(feats)} AS n_features,
         sst.missing_values, sst.imbalance_ratio, (sst.n_rows - sst.nd)::DOUBLE / sst.n_rows AS duplicate_ratio, sst.skew_score,
         sst.low_variance_fraction
  FROM met LEFT JOIN fs USING (model_id, dataset_id)
  JOIN sst ON sst.scenario = CASE WHEN met.dataset_id IN ('strong', 'extreme') THEN 'clean' ELSE met.dataset_id END),
""" + trust_sql("inp").lstrip() + "," + replicate_sql("inp") + """,
bm AS (SELECT tr.model_id, tr.dataset_id, tr.n_rows, tr.accuracy, tr.f1_score, tr.dp, tr.trust_mode, tr.P, tr.H, tr.F, tr.R, tr.DII,
              tr.trust_score, tr.guard_triggered, ci.lower_bound, ci.upper_bound, ci.std_trust
       FROM tr JOIN ci USING (model_id, dataset_id, trust_mode)),
wd AS (SELECT b.model_id, b.dataset_id AS scenario, b.n_rows, """ + ", ".join(f"{rh(f'b.{c}')} AS {c}" for c in ("accuracy", "f1_score", "dp")) + ", " \
        + ", ".join(f"{x}.{c} AS {m}_{a}" if c in ("trust_score", "guard_triggered", "lower_bound", "upper_bound", "std_trust")
                    else f"{rh(f'{x}.{c}')} AS {m}_{a}"
                    for m, x in (("balanced", "b"), ("strict", "s"))
                    for c, a in (("P", "p"), ("H", "h"), ("F", "f"), ("R", "r"), ("DII", "dii"), ("trust_score", "trust"),
                                 ("lower_bound", "low"), ("upper_bound", "high"), ("std_trust", "std"), ("guard_triggered", "guard"))) + f"""
       FROM bm b JOIN bm s ON b.model_id = s.model_id AND b.dataset_id = s.dataset_id AND b.trust_mode = 'balanced' AND s.trust_mode = 'strict')
SELECT wd.*, {rh('wd.balanced_trust - c.balanced_trust', 2)} AS balanced_delta, {rh('wd.strict_trust - c.strict_trust', 2)} AS strict_delta
FROM wd JOIN (SELECT * FROM wd WHERE scenario = 'clean') c ON wd.model_id = c.model_id"""
