"""Registered single-operator queries (metrics, fairness, health, insights)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from trustframe.functions.expr import round_half
from trustframe.operators import fairness as FA
from trustframe.operators import health as HE
from trustframe.operators import insights as IN
from trustframe.operators import metrics as ME
from trustframe.plans import evaluation as E
from trustframe.plans import oracle as O
from trustframe.plans.catalog import register
from trustframe.session import checkpoint_dir
from trustframe.sources import workloads as W
from trustframe.sources.tables import table


def r6(c, n=6):
    return round_half(F.col(c).cast("double"), n).alias(c)


K = ["model_id", "dataset_id"]

# ----------------------------------------------------------------- metrics


@register("metrics_multiclass", "WITH " + O.MULTICLASS_PREDS + "," + O.class_metrics_sql("preds", "met") + """
SELECT model_id, dataset_id, n_rows, """ + ", ".join(f"{O.rh(c)} AS {c}" for c in
                                                      ("accuracy", "precision", "recall", "f1_score")) + " FROM met")
def q_metrics_multiclass(spark, sf):
    m = ME.classification_metrics(W.multiclass_predictions(spark, sf))
    return m.select(*K, "n_rows", *[r6(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@register("metrics_binary", "WITH " + O.BINARY_PREDS + """
SELECT model_id, dataset_id, count(*) AS n_rows,
       count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS fn, count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS tn,
       """ + O.rh("(count(*) FILTER (WHERE y_true = y_pred))::DOUBLE / count(*)") + """ AS accuracy,
       """ + O.rh("CASE WHEN count(*) FILTER (WHERE y_pred = 1) > 0 THEN (count(*) FILTER (WHERE y_true = 1 AND y_pred = 1))::DOUBLE / count(*) FILTER (WHERE y_pred = 1) ELSE 0.0::DOUBLE END") + """ AS precision,
       """ + O.rh("CASE WHEN count(*) FILTER (WHERE y_true = 1) > 0 THEN (count(*) FILTER (WHERE y_true = 1 AND y_pred = 1))::DOUBLE / count(*) FILTER (WHERE y_true = 1) ELSE 0.0::DOUBLE END") + """ AS recall,
       """ + O.rh("CASE WHEN count(*) FILTER (WHERE y_pred = 1) + count(*) FILTER (WHERE y_true = 1) > 0 THEN 2.0::DOUBLE * (count(*) FILTER (WHERE y_true = 1 AND y_pred = 1)) / (count(*) FILTER (WHERE y_pred = 1) + count(*) FILTER (WHERE y_true = 1)) ELSE 0.0::DOUBLE END") + """ AS f1_score
FROM preds GROUP BY ALL""")
def q_metrics_binary(spark, sf):
    m = ME.binary_metrics(W.binary_predictions(spark, sf))
    return m.select(*K, "n_rows", "tp", "fp", "fn", "tn",
                    *[r6(c) for c in ("accuracy", "precision", "recall", "f1_score")])


# error magnitudes here reach 1e9, so they are compared at 2 places (1e-11 relative)
_REG_R = {"mae": 4, "mse": 2, "rmse": 4, "r2_score": 6, "std_y": 4, "range_y": 4}


@register("metrics_regression", "WITH " + O.REGRESSION_PREDS + "," + O.reg_metrics_sql("preds", "met") + """
SELECT model_id, dataset_id, n_rows, """ + ", ".join(f"{O.rh(c, n)} AS {c}" for c, n in _REG_R.items()) + " FROM met")
def q_metrics_regression(spark, sf):
    m = ME.regression_metrics(W.regression_predictions(spark, sf))
    return m.select(*K, "n_rows", *[r6(c, n) for c, n in _REG_R.items()])


EMB_PREDS = """
preds AS (
  SELECT 'cv_bins' AS model_id, 'embeddings' AS dataset_id, vec_id AS row_id, label AS y_true,
         CAST(least(9, greatest(0, CAST(floor((CAST(embedding[1] AS DOUBLE) + 0.5::DOUBLE) * 10) AS INTEGER))) AS INTEGER) AS y_pred
  FROM embeddings)"""


@register("metrics_pixel", "WITH " + EMB_PREDS + """
SELECT model_id, dataset_id, count(*) AS n_rows,
       """ + O.rh("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)") + """ AS pixel_accuracy,
       """ + O.rh("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)") + """ AS iou,
       """ + O.rh("avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)") + """ AS dice_coefficient
FROM preds GROUP BY ALL""")
def q_metrics_pixel(spark, sf):
    m = ME.pixel_metrics(W.embedding_predictions(spark, sf))
    return m.select(*K, "n_rows", *[r6(c) for c in ("pixel_accuracy", "iou", "dice_coefficient")])


@register("metrics_pixel_per_class", "WITH " + EMB_PREDS + "," + O.class_metrics_sql("preds", "met") + """
SELECT model_id, dataset_id, CAST(sum(support) AS BIGINT) AS n_rows,
       """ + O.rh("sum(tp)::DOUBLE / sum(support)") + """ AS pixel_accuracy,
       """ + O.rh("avg(CASE WHEN support + predicted - tp > 0 THEN tp::DOUBLE / (support + predicted - tp) ELSE 0.0::DOUBLE END)") + """ AS iou,
       """ + O.rh("avg(CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0.0::DOUBLE END)") + """ AS dice_coefficient
FROM met_pc GROUP BY ALL""")
def q_metrics_pixel_per_class(spark, sf):
    m = ME.pixel_metrics(W.embedding_predictions(spark, sf), fixed=True)
    return m.select(*K, F.col("n_rows").cast("long").alias("n_rows"),
                    *[r6(c) for c in ("pixel_accuracy", "iou", "dice_coefficient")])


# ---------------------------------------------------------------- fairness

_GM_COLS = ("accuracy", "precision", "recall", "f1_score", "tpr", "fpr", "ppr")


@register("fairness_group_metrics", "WITH " + O.BINARY_PREDS + "," + O.class_fairness_sql(
    "preds", W.ORDER_ATTRS) + """
SELECT model_id, dataset_id, attr, grp, n, tp, fp, tn, fn, """ + ", ".join(
    f"{O.rh(c)} AS {c}" for c in _GM_COLS) + " FROM gm")
def q_fairness_group_metrics(spark, sf):
    gm = FA.group_metrics(W.binary_predictions(spark, sf), W.ORDER_ATTRS)
    ren = {"true_positive_rate": "tpr", "false_positive_rate": "fpr", "positive_prediction_rate": "ppr"}
    for a, b in ren.items():
        gm = gm.withColumnRenamed(a, b)
    return gm.select(*K, "attr", "grp", "n", "tp", "fp", "tn", "fn", *[r6(c) for c in _GM_COLS])


_GAP_COLS = ("demographic_parity_difference", "fairness_score_F", "equal_opportunity_difference",
             "disparate_impact_ratio", "statistical_parity", "predictive_parity",
             "equalized_odds_difference", "overall_fairness_score")


@register("fairness_gaps", "WITH " + O.BINARY_PREDS + "," + O.class_fairness_sql(
    "preds", W.ORDER_ATTRS) + """
SELECT model_id, dataset_id, attr, num_groups, analysis_successful, """ + ", ".join(
    f"{O.rh(c)} AS {c}" for c in _GAP_COLS) + " FROM gaps2")
def q_fairness_gaps(spark, sf):
    g = FA.fairness_gaps(FA.group_metrics(W.binary_predictions(spark, sf), W.ORDER_ATTRS))
    return g.select(*K, "attr", "num_groups", "analysis_successful", *[r6(c) for c in _GAP_COLS])


@register("fairness_docs_gaps", "WITH " + O.DOCS_PREDS + "," + O.class_fairness_sql(
    "preds", W.DOC_ATTRS) + """
SELECT model_id, dataset_id, attr, num_groups, analysis_successful, """ + ", ".join(
    f"{O.rh(c)} AS {c}" for c in _GAP_COLS) + " FROM gaps2")
def q_fairness_docs_gaps(spark, sf):
    g = FA.fairness_gaps(FA.group_metrics(W.docs_predictions(spark, sf), W.DOC_ATTRS))
    return g.select(*K, "attr", "num_groups", "analysis_successful", *[r6(c) for c in _GAP_COLS])


_RGAP = ("demographic_parity_difference", "fairness_score_F", "error_parity_difference",
         "max_prediction_gap", "max_mae_gap", "overall_fairness_score")


@register("fairness_regression", "WITH " + O.REGRESSION_PREDS + "," + O.reg_fairness_sql(
    "preds", W.LINE_ATTRS) + """
SELECT model_id, dataset_id, attr, num_groups, analysis_successful, """ + ", ".join(
    f"{O.rh(c)} AS {c}" for c in _RGAP) + " FROM gaps3")
def q_fairness_regression(spark, sf):
    g = FA.regression_fairness(FA.regression_group_stats(W.regression_predictions(spark, sf), W.LINE_ATTRS))
    return g.select(*K, "attr", "num_groups", "analysis_successful", *[r6(c) for c in _RGAP])


@register("fairness_summary", "WITH " + O.BINARY_PREDS + "," + O.class_fairness_sql(
    "preds", W.ORDER_ATTRS) + "," + O.fairness_summary_sql("gaps2") + """
SELECT model_id, dataset_id, attributes_analyzed, """ + O.rh("overall_fairness_score") + """ AS overall_fairness_score,
       primary_attribute, fairness_evaluated, """ + O.rh("dp") + """ AS dp FROM fs""")
def q_fairness_summary(spark, sf):
    s = FA.fairness_summary(FA.fairness_gaps(FA.group_metrics(W.binary_predictions(spark, sf),
                                                              W.ORDER_ATTRS)))
    return s.select(*K, "attributes_analyzed", r6("overall_fairness_score"), "primary_attribute",
                    "fairness_evaluated", r6("dp"))


@register("fairness_binary_dp", "WITH " + O.BINARY_PREDS + """,
r AS (SELECT model_id, dataset_id, c_mktsegment, avg(y_pred) AS rate FROM preds
      WHERE c_mktsegment IS NOT NULL GROUP BY ALL)
SELECT model_id, dataset_id, """ + O.rh("max(rate) - min(rate)") + """ AS demographic_parity FROM r GROUP BY ALL""")
def q_fairness_binary_dp(spark, sf):
    d = FA.binary_demographic_parity(W.binary_predictions(spark, sf), "c_mktsegment")
    return d.select(*K, r6("demographic_parity"))


@register("fairness_recommendations", "WITH " + O.BINARY_PREDS + "," + O.class_fairness_sql(
    "preds", W.ORDER_ATTRS) + """
SELECT model_id, dataset_id, attr,
       concat_ws(' | ', CASE WHEN demographic_parity_difference > 0.2::DOUBLE THEN 'dp' END,
                 CASE WHEN equal_opportunity_difference > 0.2::DOUBLE THEN 'eo' END,
                 CASE WHEN disparate_impact_ratio < 0.8::DOUBLE OR disparate_impact_ratio > 1.25::DOUBLE THEN 'di' END) AS rec_kinds,
       CASE WHEN overall_fairness_score >= 0.9::DOUBLE THEN 'excellent' WHEN overall_fairness_score >= 0.75::DOUBLE THEN 'good'
            WHEN overall_fairness_score >= 0.6::DOUBLE THEN 'fair' ELSE 'poor' END AS fairness_level
FROM gaps2""")
def q_fairness_recommendations(spark, sf):
    g = FA.fairness_recommendations(FA.fairness_gaps(FA.group_metrics(
        W.binary_predictions(spark, sf), W.ORDER_ATTRS)))
    inv = {v: k for k, v in FA.FAIRNESS_RECS.items()}
    kinds = F.array_join(F.filter(F.transform("fairness_recommendations", lambda r: F.element_at(
        F.create_map(*[x for kv in inv.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]), r)),
        lambda k: k != "ok"), " | ")
    return g.select(*K, "attr", kinds.alias("rec_kinds"),
                    FA.fairness_level(F.col("overall_fairness_score")).alias("fairness_level"))


@register("fairness_detect_attributes", "WITH " + O.ORDERS_DS + """,
c AS (SELECT count(DISTINCT o_totalprice) AS c0, count(DISTINCT o_orderpriority) AS c1, count(DISTINCT c_acctbal) AS c2,
             count(DISTINCT c_mktsegment) AS c3, count(DISTINCT n_regionkey) AS c4 FROM ds)
SELECT 'orders_status' AS dataset_id, "column", ordinal, reason, n_unique FROM (
  SELECT 'o_totalprice' AS "column", 0 AS ordinal, 'numeric' AS reason, c0 AS n_unique FROM c WHERE c0 BETWEEN 2 AND 5
  UNION ALL SELECT 'o_orderpriority', 1, 'categorical', c1 FROM c WHERE c1 BETWEEN 2 AND 10
  UNION ALL SELECT 'c_acctbal', 2, 'numeric', c2 FROM c WHERE c2 BETWEEN 2 AND 5
  UNION ALL SELECT 'c_mktsegment', 3, 'categorical', c3 FROM c WHERE c3 BETWEEN 2 AND 10
  UNION ALL SELECT 'n_regionkey', 4, 'name', c4 FROM c)""")
def q_fairness_detect(spark, sf):
    ds = W.orders_dataset(spark, sf).drop("row_id", "o_orderstatus")
    return FA.detect_sensitive_attributes(ds, ["target"], "orders_status")


# ------------------------------------------------------------------ health

_ST = ("n_rows", "n_features", "missing_values")
_STD = ("imbalance_ratio", "duplicate_ratio", "skew_score", "low_variance_fraction")

HEALTH_TABLES = {
    # table: (columns, numeric columns, target, model_type)
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                 ["c_custkey", "c_nationkey", "c_acctbal"], "c_mktsegment", "classification"),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
             ["p_partkey", "p_size"], "p_retailprice", "regression"),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"],
                 ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax"], "l_linestatus", "classification"),
}

for _t, (_cols, _num, _tgt, _mt) in HEALTH_TABLES.items():
    def _mk(t, cols, tgt, mt):
        def q(spark, sf):
            df = table(spark, sf, t).select(*cols)
            st = HE.dataset_stats(df, t, tgt, model_type=mt)
            return st.select("dataset_id", *_ST, *[r6(c) for c in _STD])
        return q
    _sql = ("WITH ds2 AS (SELECT " + ", ".join(_cols) + f" FROM {_t})," + O.stats_sql(
        "ds2", _t, _cols, [c for c in _num if c != _tgt], _tgt, _mt)
        + "\nSELECT dataset_id, " + ", ".join(_ST) + ", " + ", ".join(f"{O.rh(c)} AS {c}" for c in _STD)
        + " FROM st")
    register(f"health_stats_{_t}", _sql)(_mk(_t, _cols, _tgt, _mt))


def _many_sql() -> str:
    """The three tables' statistics under one another."""
    parts = []
    for t, (cols, num, tgt, mt) in HEALTH_TABLES.items():
        parts.append("SELECT * FROM (WITH ds2 AS (SELECT " + ", ".join(cols) + f" FROM {t})," + O.stats_sql(
            "ds2", t, cols, [c for c in num if c != tgt], tgt, mt)
            + "\nSELECT dataset_id, " + ", ".join(_ST) + ", " + ", ".join(f"{O.rh(c)} AS {c}" for c in _STD) + " FROM st)")
    return "\nUNION ALL\n".join(parts)


@register("health_stats_many", _many_sql())
def q_health_many(spark, sf):
    st = HE.many_dataset_stats([HE.Dataset(table(spark, sf, t).select(*cols), t, tgt, model_type=mt)
                                for t, (cols, _, tgt, mt) in HEALTH_TABLES.items()])
    return st.select("dataset_id", *_ST, *[r6(c) for c in _STD])


@register("health_stats_experiment", """
WITH s AS (SELECT count(*) AS n_rows,
  CAST(count(*) FILTER (WHERE c_custkey IS NULL) + count(*) FILTER (WHERE c_name IS NULL) + count(*) FILTER (WHERE c_nationkey IS NULL)
       + count(*) FILTER (WHERE c_acctbal IS NULL) + count(*) FILTER (WHERE c_mktsegment IS NULL) AS BIGINT) AS missing_values,
  (CASE WHEN var_samp(c_custkey) < 0.01::DOUBLE THEN 1 ELSE 0 END + CASE WHEN var_samp(c_nationkey) < 0.01::DOUBLE THEN 1 ELSE 0 END
   + CASE WHEN var_samp(c_acctbal) < 0.01::DOUBLE THEN 1 ELSE 0 END)::DOUBLE / 3 AS low_variance_fraction,
  tanh((abs(skewness(c_custkey)) + abs(skewness(c_nationkey)) + abs(skewness(c_acctbal))) / 3.0::DOUBLE / 3.0::DOUBLE) AS skew_score
  FROM customer),
k AS (SELECT min(c)::DOUBLE / max(c) AS imbalance_ratio FROM (SELECT count(*) AS c FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)),
d AS (SELECT count(*) AS nd FROM (SELECT DISTINCT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer))
SELECT 'customer' AS dataset_id, n_rows, 4 AS n_features, missing_values, """ + O.rh("imbalance_ratio") + """ AS imbalance_ratio,
       """ + O.rh("(n_rows - nd)::DOUBLE / n_rows") + """ AS duplicate_ratio, """ + O.rh("skew_score") + """ AS skew_score,
       """ + O.rh("low_variance_fraction") + """ AS low_variance_fraction
FROM s, k, d""")
def q_health_experiment(spark, sf):
    cols, _, tgt, mt = HEALTH_TABLES["customer"]
    st = HE.dataset_stats(table(spark, sf, "customer").select(*cols), "customer", tgt, model_type=mt,
                          variant="experiment")
    return st.select("dataset_id", *_ST, *[r6(c) for c in _STD])


# ---------------------------------------------------------------- insights

INSIGHT_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}
INSIGHT_NUMERIC = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"],
}


def quality_sql(t: str) -> str:
    cols, num = INSIGHT_TABLES[t], INSIGHT_NUMERIC[t]
    nn = " + ".join(f"count({c})" for c in cols)
    uniq = " + ".join(f"count(DISTINCT {c})::DOUBLE / count(*) * 100.0::DOUBLE" for c in cols)
    qs = ",\n".join(f"q_{c} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"
                    for c in num)
    outs = " + ".join(
        f"(SELECT count(*) FROM {t}, q_{c} WHERE {c} < q1 - 1.5::DOUBLE * (q3 - q1) OR {c} > q3 + 1.5::DOUBLE * (q3 - q1))"
        for c in num)
    ncols = len(cols)
    return f"""WITH {qs},
b AS (SELECT count(*) AS n, ({nn})::DOUBLE / (count(*) * {ncols}) * 100.0::DOUBLE AS comp,
             least(100.0::DOUBLE, ({uniq}) / {ncols}) AS uniq, count(*) * {ncols} - ({nn}) AS miss FROM {t}),
c AS (SELECT *, (n * {len(num)} - ({outs}))::DOUBLE / (n * {len(num)}) * 100.0::DOUBLE AS cons FROM b)
SELECT '{t}' AS dataset_id, {O.rh('comp', 1)} AS completeness, 100.0::DOUBLE AS validity,
       {O.rh('uniq', 1)} AS uniqueness, {O.rh('cons', 1)} AS consistency,
       {O.rh('(comp + 100.0::DOUBLE + uniq + cons) / 4.0::DOUBLE', 1)} AS overall_score,
       n AS total_rows, {ncols} AS total_columns, CAST(miss AS BIGINT) AS missing_values,
       CASE WHEN (comp + 100.0::DOUBLE + uniq + cons) / 4.0::DOUBLE >= 80 THEN 'good'
            WHEN (comp + 100.0::DOUBLE + uniq + cons) / 4.0::DOUBLE >= 60 THEN 'warning' ELSE 'poor' END AS status
FROM c"""


def outliers_sql(t: str) -> str:
    num = INSIGHT_NUMERIC[t]
    parts = []
    for i, c in enumerate(num):
        parts.append(f"""SELECT '{c}' AS feature, {i} AS col_ord, count({c}) AS n, count(*) AS n_all,
       quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
       min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, avg({c}) AS mean, stddev_samp({c}) AS std,
       (SELECT count(*) FROM {t} x WHERE x.{c} < (SELECT quantile_cont({c}, 0.25) - 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {t})
          OR x.{c} > (SELECT quantile_cont({c}, 0.75) + 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {t})) AS outliers
FROM {t}""")
    u = "\nUNION ALL\n".join(parts)
    pct = "outliers::DOUBLE / n_all * 100.0::DOUBLE"
    imp = f"CASE WHEN {pct} > 10 THEN 'high' WHEN {pct} > 5 THEN 'medium' ELSE 'low' END"
    return f"""WITH u AS ({u})
SELECT feature, col_ord, outliers AS count, {O.rh(pct, 2)} AS percentage, {imp} AS impact,
       {O.rh('q1 - 1.5::DOUBLE * (q3 - q1)')} AS lower_bound, {O.rh('q3 + 1.5::DOUBLE * (q3 - q1)')} AS upper_bound,
       {O.rh('min_value')} AS min_value, {O.rh('max_value')} AS max_value, {O.rh('mean')} AS mean, {O.rh('std')} AS std,
       CASE WHEN {pct} > 10 THEN 0 WHEN {pct} > 5 THEN 1 ELSE 2 END AS impact_ord
FROM u WHERE n >= 3 AND outliers > 0"""


def pearson_sql(t: str, threshold: float) -> str:
    num = INSIGHT_NUMERIC[t]
    parts = [f"SELECT '{num[i]}' AS feature1, '{num[j]}' AS feature2, {i} AS i, {j} AS j, corr({num[i]}, {num[j]}) AS r FROM {t}"
             for i in range(len(num)) for j in range(i + 1, len(num))]
    return _pairs_sql("\nUNION ALL\n".join(parts), threshold)


def _pairs_sql(u: str, threshold: float) -> str:
    return f"""WITH u AS ({u})
SELECT feature1, feature2, i, j, {O.rh('r', 4)} AS correlation, {O.rh('abs(r)', 4)} AS abs_correlation,
       CASE WHEN abs(r) >= 0.8::DOUBLE THEN 'very_strong' WHEN abs(r) >= 0.6::DOUBLE THEN 'strong' ELSE 'moderate' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, abs(r) >= 0.7::DOUBLE AS is_strong
FROM u WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= {O.d(threshold)}"""


def spearman_sql(t: str, threshold: float) -> str:
    num = INSIGHT_NUMERIC[t]
    parts = []
    for i in range(len(num)):
        for j in range(i + 1, len(num)):
            a, b = num[i], num[j]
            parts.append(f"""SELECT '{a}' AS feature1, '{b}' AS feature2, {i} AS i, {j} AS j, corr(ra, rb) AS r FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb
  FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return _pairs_sql("\nUNION ALL\n".join(parts), threshold)


_OUT_COLS = ("lower_bound", "upper_bound", "min_value", "max_value", "mean", "std")

for _t in INSIGHT_TABLES:
    def _mkq(t):
        def q_quality(spark, sf):
            return IN.data_quality(table(spark, sf, t).select(*INSIGHT_TABLES[t]), t)

        def q_outliers(spark, sf):
            o = IN.outliers_iqr(table(spark, sf, t).select(*INSIGHT_TABLES[t]))
            return o.select("feature", "col_ord", "count", "percentage", "impact",
                            *[r6(c) for c in _OUT_COLS], "impact_ord")

        def q_pearson(spark, sf):
            return IN.pearson_pairs(table(spark, sf, t).select(*INSIGHT_TABLES[t]), 0.0)

        def q_pearson05(spark, sf):
            return IN.pearson_pairs(table(spark, sf, t).select(*INSIGHT_TABLES[t]), 0.5)

        def q_spearman(spark, sf):
            return IN.spearman_pairs(table(spark, sf, t).select(*INSIGHT_TABLES[t]), 0.0)
        return q_quality, q_outliers, q_pearson, q_pearson05, q_spearman
    _qq, _qo, _qp, _qp5, _qs = _mkq(_t)
    register(f"insights_quality_{_t}", quality_sql(_t))(_qq)
    register(f"insights_outliers_iqr_{_t}", outliers_sql(_t))(_qo)
    register(f"insights_pearson_matrix_{_t}", pearson_sql(_t, 0.0))(_qp)
    register(f"insights_pearson_pairs_{_t}", pearson_sql(_t, 0.5))(_qp5)
    register(f"insights_spearman_matrix_{_t}", spearman_sql(_t, 0.0))(_qs)


_PRICED = ["l_quantity", "p_retailprice", "l_extendedprice", "l_discount", "list_price", "rebate"]


@register("insights_pearson_pairs_priced", """
WITH priced AS (SELECT l_quantity, p_retailprice, l_extendedprice, l_discount, l_quantity * p_retailprice AS list_price,
                       -l_extendedprice * l_discount AS rebate FROM lineitem JOIN part ON l_partkey = p_partkey),
""" + _pairs_sql("\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM priced"
    for i, a in enumerate(_PRICED) for j, b in enumerate(_PRICED) if i < j), 0.5)[len("WITH "):] + """
ORDER BY abs_correlation DESC, i, j LIMIT 20""")
def q_pairs_priced(spark, sf):
    """A16 with pairs that do correlate: the 20 strongest at |r| of 0.5 or more."""
    li, pa = table(spark, sf, "lineitem"), table(spark, sf, "part")
    df = li.join(pa, li.l_partkey == pa.p_partkey).select(
        "l_quantity", "p_retailprice", "l_extendedprice", "l_discount",
        (F.col("l_quantity") * F.col("p_retailprice")).alias("list_price"),
        (-F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"))
    return IN.pearson_pairs(df, 0.5).orderBy(F.col("abs_correlation").desc(), "i", "j").limit(20)


@register("insights_outliers_zscore_events", """
WITH u AS (""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, {i} AS col_ord, count({c}) AS n, count(*) AS n_all, avg({c}) AS mean,
       stddev_pop({c}) AS sp, stddev_samp({c}) AS std, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value,
       (SELECT count(*) FROM events x, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM events) y
        WHERE y.s > 0 AND abs(x.{c} - y.m) / y.s > 3) AS outliers FROM events"""
    for i, c in enumerate(["event_id", "user_id", "value"])) + """)
SELECT feature, col_ord, outliers AS count, """ + O.rh("outliers::DOUBLE / n_all * 100.0::DOUBLE", 2) + """ AS percentage,
       CASE WHEN outliers::DOUBLE / n_all * 100 > 10 THEN 'high' WHEN outliers::DOUBLE / n_all * 100 > 5 THEN 'medium' ELSE 'low' END AS impact,
       """ + O.rh("mean - 3 * std") + " AS lower_bound, " + O.rh("mean + 3 * std") + """ AS upper_bound,
       """ + O.rh("min_value") + " AS min_value, " + O.rh("max_value") + " AS max_value, " + O.rh("mean") + " AS mean, " + O.rh("std") + """ AS std
FROM u WHERE n >= 3 AND outliers > 0""")
def q_outliers_z(spark, sf):
    o = IN.outliers_zscore(table(spark, sf, "events").select(*INSIGHT_TABLES["events"]))
    return o.select("feature", "col_ord", "count", "percentage", "impact", *[r6(c) for c in _OUT_COLS])


def summary_sql(t: str) -> str:
    """T21 and T24 from the quality, outlier and pair relations of a table."""
    return f"""SELECT q.dataset_id, concat_ws(' ',
  CASE WHEN overall_score >= 90 THEN printf('Your dataset shows excellent quality with a %.1f%% overall score.', overall_score)
       WHEN overall_score >= 75 THEN printf('Your dataset shows good quality with a %.1f%% overall score.', overall_score)
       WHEN overall_score >= 60 THEN printf('Your dataset has moderate quality (%.1f%% score) and could benefit from improvements.', overall_score)
       ELSE printf('Your dataset needs attention with a %.1f%% quality score.', overall_score) END,
  CASE WHEN tot > 0 THEN printf('Found %d outliers across %d features.', tot, affected) END,
  CASE WHEN tot > 0 AND len(high) > 0 THEN 'High-impact outliers detected in: ' || array_to_string(high[1:3], ', ') || '.' END,
  CASE WHEN top.feature1 IS NOT NULL THEN printf('Strong %s correlation (%.2f) found between %s and %s.', top.direction, top.correlation, top.feature1, top.feature2) END,
  CASE WHEN completeness < 95 THEN 'Consider handling missing values to improve data completeness.' END,
  CASE WHEN tot > total_rows * 0.05 THEN 'Review and potentially remove or transform outliers before model training.' END) AS summary,
  CASE WHEN completeness >= 95 THEN 'good' WHEN completeness >= 80 THEN 'warning' ELSE 'poor' END AS completeness_status,
  CASE WHEN validity >= 95 THEN 'good' WHEN validity >= 80 THEN 'warning' ELSE 'poor' END AS validity_status,
  CASE WHEN uniqueness >= 70 THEN 'good' WHEN uniqueness >= 50 THEN 'warning' ELSE 'poor' END AS uniqueness_status,
  CASE WHEN consistency >= 95 THEN 'good' WHEN consistency >= 80 THEN 'warning' ELSE 'poor' END AS consistency_status,
  concat_ws('; ', CASE WHEN missing_values > 0 THEN printf('%d missing values detected', missing_values) END,
    CASE WHEN completeness < 95 THEN printf('Completeness is %.1f%% (below 95%%)', completeness) END,
    CASE WHEN validity < 95 THEN printf('Data validity is %.1f%% (below 95%%)', validity) END,
    CASE WHEN uniqueness < 70 THEN printf('Uniqueness is %.1f%% (below 70%%)', uniqueness) END) AS issues
FROM ({quality_sql(t)}) q,
(SELECT coalesce(sum("count"), 0)::BIGINT AS tot, count(*) AS affected,
        coalesce(list(feature ORDER BY "count" DESC, col_ord) FILTER (impact = 'high'), []) AS high FROM ({outliers_sql(t)})),
(SELECT first(x) AS top FROM (SELECT struct_pack(direction, correlation, feature1, feature2) AS x FROM ({pearson_sql(t, 0.5)}) WHERE is_strong
                              ORDER BY abs_correlation DESC, i, j LIMIT 1))"""


@register("insights_summary", "\nUNION ALL\n".join(summary_sql(t) for t in INSIGHT_TABLES))
def q_insights_summary(spark, sf):
    """T21 and T24 of each table.  A table's fences are found once for quality and outliers; the tables are
    gone through at the same time, as the small ones don't fill a cluster."""
    def one(t):
        df = table(spark, sf, t).select(*INSIGHT_TABLES[t])
        f = IN.fences(df)
        qd = E._materialise(IN.data_quality(df, t, fenced=f))  # one row, read twice
        o = IN.outliers_iqr(df, fenced=f).withColumn("dataset_id", F.lit(t))
        p = IN.pearson_pairs(df, 0.5).withColumn("dataset_id", F.lit(t))
        s = IN.insights_summary(qd, o, p)
        return s.join(IN.quality_status(qd), "dataset_id")

    checkpoint_dir(spark)  # named before the threads start
    with ThreadPoolExecutor(len(INSIGHT_TABLES)) as pool:
        outs = list(pool.map(inheritable_thread_target(spark)(one), INSIGHT_TABLES))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


@register("fairness_labels", "WITH " + O.BINARY_PREDS + "," + O.class_fairness_sql("preds", W.ORDER_ATTRS) + """,
l AS (UNPIVOT (SELECT model_id, dataset_id, attr, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _GAP_COLS) + """ FROM gaps2)
      ON """ + ", ".join(_GAP_COLS) + """ INTO NAME metric VALUE value)
SELECT model_id, dataset_id, attr, metric, """ + O.rh("value") + """ AS value,
  CASE WHEN metric LIKE '%\\_difference' ESCAPE '\\' THEN CASE WHEN value <= 0.1::DOUBLE THEN 'good' WHEN value <= 0.2::DOUBLE THEN 'fair' ELSE 'poor' END
       WHEN metric LIKE '%\\_ratio' ESCAPE '\\' THEN CASE WHEN value BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE THEN 'good'
                                            WHEN value BETWEEN 0.6::DOUBLE AND 1.5::DOUBLE THEN 'fair' ELSE 'poor' END
       ELSE CASE WHEN value >= 0.8::DOUBLE THEN 'good' WHEN value >= 0.6::DOUBLE THEN 'fair' ELSE 'poor' END END AS label
FROM l""")
def q_fairness_labels(spark, sf):
    """Every fairness metric with its label."""
    g = FA.fairness_gaps(FA.group_metrics(W.binary_predictions(spark, sf), W.ORDER_ATTRS)).select(*K, "attr", *_GAP_COLS)
    return FA.labelled_metrics(g, list(_GAP_COLS)).select(*K, "attr", "metric", r6("value"), "label")
