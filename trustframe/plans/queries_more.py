"""Registered experiment, sweep, text, attribution and preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustframe.functions.expr import round_half
from trustframe.functions.trust import trust_columns
from trustframe.operators import attribution as AT
from trustframe.operators import prep as PR
from trustframe.operators import registry as RG
from trustframe.operators import text as TX
from trustframe.operators.fairness import group_metrics
from trustframe.plans import evaluation as E
from trustframe.plans import experiment as X
from trustframe.plans import oracle as O
from trustframe.plans.catalog import register
from trustframe.sources import registry as SR
from trustframe.sources import workloads as W
from trustframe.sources.tables import table


def r6(c, n=6):
    return round_half(F.col(c).cast("double"), n).alias(c)


K = ["model_id", "dataset_id"]

# --------------------------------------------------------------- sweeps


@register("sweep_lambda_sensitivity", O.lambda_sensitivity_sql("orders_status"))
def q_lambda(spark, sf):
    inp = E.evaluation_inputs(spark, sf, E.WORKLOADS["orders_status"])
    scored = trust_columns(E.eval_score_columns(inp).withColumn(
        "trust_mode", F.explode(F.array(F.lit("balanced"), F.lit("strict")))), with_text=False)
    return X.lambda_sensitivity(scored, K).drop("_t")


@register("sweep_lambda_summary", O.lambda_summary_sql("lineitem_price"))
def q_lambda_summary(spark, sf):
    inp = E.evaluation_inputs(spark, sf, E.WORKLOADS["lineitem_price"])
    scored = trust_columns(E.eval_score_columns(inp).withColumn(
        "trust_mode", F.explode(F.array(F.lit("balanced"), F.lit("strict")))), with_text=False)
    return X.lambda_sensitivity_summary(X.lambda_sensitivity(scored, K), K)


@register("sweep_replicate_ci", O.materialised(O.evaluation_ctes("orders_status") + "," + O.replicate_sql("inp") + "\nSELECT * FROM ci"))
def q_replicate(spark, sf):
    inp = E.evaluation_inputs(spark, sf, E.WORKLOADS["orders_status"])
    return X.replicate_ci(inp, K, n_runs=10)


@register("sweep_mode_comparison", O.evaluation_ctes("docs_quality") + """
SELECT model_id, dataset_id, max(CASE WHEN trust_mode = 'balanced' THEN trust_score END) AS balanced_trust,
       max(CASE WHEN trust_mode = 'balanced' THEN DII END) AS balanced_dii,
       bool_or(CASE WHEN trust_mode = 'balanced' THEN guard_triggered END) AS balanced_guard,
       max(CASE WHEN trust_mode = 'strict' THEN trust_score END) AS strict_trust,
       max(CASE WHEN trust_mode = 'strict' THEN DII END) AS strict_dii,
       bool_or(CASE WHEN trust_mode = 'strict' THEN guard_triggered END) AS strict_guard,
       """ + O.rh("max(CASE WHEN trust_mode = 'balanced' THEN trust_score END) - max(CASE WHEN trust_mode = 'strict' THEN trust_score END)", 2) + """ AS trust_gap
FROM tr GROUP BY model_id, dataset_id""")
def q_modes(spark, sf):
    return E.mode_comparison(E.evaluate_workload(spark, sf, "docs_quality"))


# ---------------------------------------------------------- experiments


@register("experiment_fold_results", O.fold_results_sql() + """
SELECT model_id, fold, """ + ", ".join(f"{O.rh(c)} AS {c}" for c in ("accuracy", "f1_score", "dp"))
          + ", trust_balanced, trust_strict FROM fr")
def q_folds(spark, sf):
    f = X.fold_results(spark, sf)
    return f.select("model_id", "fold", r6("accuracy"), r6("f1_score"), r6("dp"), "trust_balanced", "trust_strict")


_FS = [f"{c}_{s}" for c in ("accuracy", "f1_score", "trust_balanced", "trust_strict") for s in ("mean", "std")]


@register("experiment_fold_summary", O.fold_results_sql() + """
SELECT model_id, count(*) AS n_folds, """ + ", ".join(
    f"{O.rh(f'avg({c})')} AS {c}_mean, {O.rh(f'stddev_pop({c})')} AS {c}_std"
    for c in ("accuracy", "f1_score", "trust_balanced", "trust_strict")) + " FROM fr GROUP BY model_id")
def q_fold_summary(spark, sf):
    return X.fold_summary(X.fold_results(spark, sf)).select("model_id", "n_folds", *[r6(c) for c in _FS])


def _p_sql(t: str, df: int) -> str:
    """Two-sided p of Student's t in closed form (Abramowitz and Stegun 26.7.3, 26.7.4)."""
    th = f"atan(abs({t}) / sqrt({df}.0::DOUBLE))"
    term, terms = 1.0, []
    for k in range(df // 2 if df % 2 == 0 else (df - 1) // 2):
        power = 2 * k if df % 2 == 0 else 2 * k + 1
        terms.append(f"{term!r}::DOUBLE * pow(cos({th}), {power})")
        term *= (2 * k + 1) / (2 * k + 2) if df % 2 == 0 else (2 * k + 2) / (2 * k + 3)
    total = f"sin({th}) * ({' + '.join(terms)})"
    return f"(1.0::DOUBLE - {total})" if df % 2 == 0 else f"(1.0::DOUBLE - 2.0::DOUBLE / pi() * ({th} + {total}))"


_STARS = ("CASE WHEN p < 0.001::DOUBLE THEN '***' WHEN p < 0.01::DOUBLE THEN '**' WHEN p < 0.05::DOUBLE THEN '*' ELSE 'ns' END")


def _ttest_sql(keys: str, diffs: str) -> str:
    return f""",
pd0 AS ({diffs}),
pd1 AS (SELECT {keys}, count(*) AS n, avg(x) AS mean_diff, stddev_samp(x) AS sd_diff FROM pd0 GROUP BY {keys}),
pd2 AS (SELECT *, mean_diff / (sd_diff / sqrt(n)) AS t_stat FROM pd1),
pd3 AS (SELECT *, {_p_sql("t_stat", 4)} AS p FROM pd2)
SELECT {keys}, n, {O.rh("mean_diff")} AS mean_diff, {O.rh("sd_diff")} AS sd_diff, {O.rh("t_stat")} AS t_stat,
       {O.rh("p")} AS p_value, {_STARS} AS significance FROM pd3"""


_T_COLS = ("mean_diff", "sd_diff", "t_stat", "p_value")


@register("experiment_ttest_modes", O.fold_results_sql() + _ttest_sql(
    "model_id", "SELECT model_id, trust_balanced - trust_strict AS x FROM fr"))
def q_ttest(spark, sf):
    t = X.balanced_vs_strict(X.fold_results(spark, sf))
    return t.select("model_id", "n", *[r6(c) for c in _T_COLS], "significance")


@register("experiment_ttest_models", O.fold_results_sql() + _ttest_sql(
    "model_a, model_b", "SELECT a.model_id AS model_a, b.model_id AS model_b, a.trust_balanced - b.trust_balanced AS x "
                        "FROM fr a JOIN fr b ON a.fold = b.fold AND a.model_id < b.model_id"))
def q_ttest_models(spark, sf):
    t = X.model_vs_model(X.fold_results(spark, sf))
    return t.select("model_a", "model_b", "n", *[r6(c) for c in _T_COLS], "significance")


_CORR_PAIRS = [("accuracy", "trust_balanced"), ("accuracy", "trust_strict"), ("f1_score", "trust_balanced"),
               ("dp", "trust_balanced")]


@register("experiment_correlation", O.fold_results_sql() + ",\nrr AS (" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, corr({x}, {y}) AS r FROM fr" for x, y in _CORR_PAIRS) + """),
r2 AS (SELECT *, r * sqrt((n - 2)::DOUBLE / (1.0::DOUBLE - r * r)) AS t FROM rr)
SELECT x, y, n, """ + O.rh("r") + " AS r, " + O.rh(_p_sql("t", 13)) + " AS p_value FROM r2")
def q_corr(spark, sf):
    f = X.fold_results(spark, sf)
    out = None
    for x, y in _CORR_PAIRS:
        c = X.correlation_p(f, x, y).select("x", "y", "n", r6("r"), r6("p_value"))
        out = c if out is None else out.unionByName(c)
    return out


@register("experiment_correlation_models", O.fold_results_sql() + """,
rr AS (SELECT model_id, count(*) AS n, corr(accuracy, trust_balanced) AS r FROM fr GROUP BY model_id)
SELECT model_id, n, """ + O.rh("r") + " AS r FROM rr")
def q_corr_models(spark, sf):
    """A27 within each model: accuracy against balanced trust over its folds."""
    return X.correlation_p(X.fold_results(spark, sf), "accuracy", "trust_balanced", ["model_id"]).select("model_id", "n", r6("r"))


@register("experiment_fairness_weight_sweep", O.fairness_weight_sweep_sql(X.FAIRNESS_WEIGHTS) + """
SELECT model_id, trust_mode, w_f, trust_score, """ + O.rh("delta") + " AS delta FROM sw")
def q_fw(spark, sf):
    return X.fairness_weight_sweep(spark, sf, X.fold_results(spark, sf)).select(
        "model_id", "trust_mode", "w_f", "trust_score", r6("delta"))


@register("experiment_ablation_summary", O.fairness_weight_sweep_sql(X.FAIRNESS_WEIGHTS) + """
SELECT model_id, trust_mode, """ + O.rh("max(trust_score) - min(trust_score)") + " AS score_range, "
          + O.rh("stddev_samp(trust_score)") + " AS score_std FROM sw GROUP BY model_id, trust_mode")
def q_ablation(spark, sf):
    a = X.ablation_summary(X.fairness_weight_sweep(spark, sf, X.fold_results(spark, sf)))
    return a.select("model_id", "trust_mode", r6("score_range"), r6("score_std"))


_NI_COLS = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey", "target"]
_NI_NUM = ["o_totalprice", "c_acctbal"]
_U = "('0x' || substr(md5('42|' || CAST(row_id AS VARCHAR) || '|{c}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_SK = [f"(CASE WHEN count({c}) >= 3 THEN CASE WHEN var_samp({c}) = 0 THEN 0.0::DOUBLE ELSE abs(skewness({c})) END END)"
       for c in _NI_NUM]


@register("scenario_null_injection_stats", "WITH " + O.ORDERS_DS + """,
sc AS (SELECT * FROM (VALUES ('clean', 0.0::DOUBLE), ('moderate', 0.10::DOUBLE), ('severe', 0.30::DOUBLE)) v(name, p)),
inj AS (SELECT sc.name, """ + ", ".join(
    (f"CASE WHEN {_U.format(c=c)} < sc.p THEN NULL ELSE {c} END AS {c}" if c not in ("c_mktsegment", "target") else c)
    for c in _NI_COLS) + """ FROM ds, sc),
b AS (SELECT name, count(*) AS n_rows, CAST(""" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _NI_COLS)
    + """ AS BIGINT) AS missing_values,
        (""" + " + ".join(f"CASE WHEN var_samp({c}) < 0.01::DOUBLE THEN 1 ELSE 0 END" for c in _NI_NUM) + """)::DOUBLE / 2 AS low_variance_fraction,
        """ + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in _SK) + """ AS n_ok,
        """ + " + ".join(f"coalesce({x}, 0.0::DOUBLE)" for x in _SK) + """ AS tot
      FROM inj GROUP BY name),
k AS (SELECT name, max(c) AS mx FROM (SELECT name, target, count(*) AS c FROM inj WHERE target IS NOT NULL GROUP BY ALL) GROUP BY name),
d AS (SELECT name, count(*) AS nd FROM (SELECT DISTINCT * FROM inj) GROUP BY name)
SELECT b.name AS dataset_id, n_rows, 5 AS n_features, missing_values,
       """ + O.rh("coalesce(mx::DOUBLE / n_rows, 0.5::DOUBLE)") + """ AS imbalance_ratio,
       """ + O.rh("(n_rows - nd)::DOUBLE / greatest(n_rows, 1)") + """ AS duplicate_ratio,
       """ + O.rh("CASE WHEN n_ok = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, tot / n_ok / 3.0::DOUBLE) END") + """ AS skew_score,
       """ + O.rh("low_variance_fraction") + """ AS low_variance_fraction
FROM b JOIN k USING (name) JOIN d USING (name)""")
def q_null_injection(spark, sf):
    return _q_null_injection(spark, sf).select(
        "dataset_id", "n_rows", "n_features", "missing_values",
        *[r6(c) for c in ("imbalance_ratio", "duplicate_ratio", "skew_score", "low_variance_fraction")])


def _q_null_injection(spark, sf):
    from trustframe.operators.health import Dataset, many_dataset_stats
    ds = W.orders_dataset(spark, sf).select("row_id", *X.FEATURES, "target")
    return many_dataset_stats([Dataset(X.inject_nulls(ds, "row_id", ["target", X.SENSITIVE], p).drop("row_id"), name, "target")
                               for name, p in (("clean", 0.0), ("moderate", 0.10), ("severe", 0.30))])


@register("scenario_oversample_majority", "WITH " + O.ORDERS_DS + """,
c AS (SELECT target, count(*) AS n FROM ds GROUP BY target),
mj AS (SELECT target, n FROM c ORDER BY n DESC, target LIMIT 1),
pos AS (SELECT ds.row_id, ds.target, row_number() OVER (ORDER BY ds.row_id) - 1 AS p
        FROM ds JOIN mj ON ds.target = mj.target),
dr AS (SELECT CAST(floor(('0x' || substr(md5('42|' || CAST(g.d AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * mj.n) AS BIGINT) AS p
       FROM mj, generate_series(0, CAST(floor(mj.n * 0.2::DOUBLE) AS BIGINT) - 1) g(d)),
ex AS (SELECT pos.row_id, pos.target FROM dr JOIN pos USING (p)),
al AS (SELECT row_id, target FROM ds UNION ALL SELECT row_id, target FROM ex)
SELECT target, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS row_id_sum FROM al GROUP BY target""")
def q_oversample(spark, sf):
    ds = W.orders_dataset(spark, sf).select("row_id", *X.FEATURES, "target")
    over = X.oversample_majority(ds, "target", "row_id", 0.2)
    return over.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").cast("long").alias("row_id_sum"))


@register("scenario_forced_predictions", "WITH " + O.BINARY_PREDS + """
SELECT model_id, dataset_id, c_mktsegment, """ + O.rh("avg(y_pred)") + """ AS rate_before,
       """ + O.rh("avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE y_pred END)") + """ AS rate_after
FROM preds GROUP BY ALL""")
def q_forced(spark, sf):
    preds = W.binary_predictions(spark, sf)
    strong = X.force_predictions(preds, "c_mktsegment", "BUILDING", "strong")
    return X.before_after_rates(preds, strong, K, "c_mktsegment").select(
        *K, "c_mktsegment", r6("rate_before"), r6("rate_after"))


_SCEN_SQL = ("WITH " + O.BINARY_PREDS + """,
sp2 AS (
  SELECT 'normal' AS scenario, model_id, dataset_id, split, y_true, y_pred, c_mktsegment, n_regionkey, o_orderpriority FROM preds
  UNION ALL SELECT 'strong', model_id, dataset_id, split, y_true,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE y_pred END, c_mktsegment, n_regionkey, o_orderpriority FROM preds
  UNION ALL SELECT 'extreme', model_id, dataset_id, split, y_true,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, c_mktsegment, n_regionkey, o_orderpriority FROM preds),
sp3 AS (SELECT scenario || '|' || model_id AS model_id, dataset_id, y_true, y_pred, c_mktsegment, n_regionkey, o_orderpriority FROM sp2),"""
             + O.class_fairness_sql("sp3", W.ORDER_ATTRS) + "," + O.fairness_summary_sql("gaps2") + """,
f2 AS (SELECT split_part(model_id, '|', 1) AS scenario, split_part(model_id, '|', 2) AS model_id, dataset_id, dp,
              attributes_analyzed, overall_fairness_score, primary_attribute, fairness_evaluated FROM fs)
SELECT a.model_id, a.dataset_id, a.scenario, a.attributes_analyzed, """ + O.rh("a.overall_fairness_score") + """ AS overall_fairness_score,
       a.primary_attribute, a.fairness_evaluated, """ + O.rh("a.dp") + " AS dp, " + O.rh("b.dp") + " AS dp_normal, "
             + O.rh("a.dp - b.dp") + """ AS dp_delta
FROM f2 a JOIN (SELECT * FROM f2 WHERE scenario = 'normal') b ON a.model_id = b.model_id AND a.dataset_id = b.dataset_id""")


@register("scenario_comparison", _SCEN_SQL)
def q_scenarios(spark, sf):
    return _q_scenarios(spark, sf).select(
        *K, "scenario", "attributes_analyzed", r6("overall_fairness_score"), "primary_attribute",
        "fairness_evaluated", r6("dp"), r6("dp_normal"), r6("dp_delta"))


def _q_scenarios(spark, sf):
    """M8, fairness alone: clean and biased predictions through the fairness path (``scenario_table`` has the rest)."""
    from trustframe.operators.fairness import fairness_gaps, fairness_summary
    preds = W.binary_predictions(spark, sf)
    outs = []
    for name, p in (("normal", preds), ("strong", X.force_predictions(preds, "c_mktsegment", "BUILDING", "strong")),
                    ("extreme", X.force_predictions(preds, "c_mktsegment", "BUILDING", "extreme"))):
        fs = fairness_summary(fairness_gaps(group_metrics(p, W.ORDER_ATTRS)))
        outs.append(fs.withColumn("scenario", F.lit(name)))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    base = res.filter(F.col("scenario") == "normal").select(*K, F.col("dp").alias("dp_normal"))
    return res.join(base, K).withColumn("dp_delta", F.col("dp") - F.col("dp_normal"))


@register("scenario_table", O.materialised(O.scenario_table_sql("BUILDING")))
def q_scenario_table(spark, sf):
    t = X.scenario_table(spark, sf, "BUILDING")
    whole = {"model_id", "scenario", "n_rows"} | {f"{m}_{c}" for m in ("balanced", "strict") for c in ("guard",)}
    return t.select(*[c if c in whole else r6(c) for c in t.columns])


# ----------------------------------------------------------------- text

PAIRS_SQL = """
pairs AS (SELECT u.conv_id, u.turn, a.text AS prediction, u.text AS reference
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""


def _ngram_sql(tok_expr_p: str, tok_expr_r: str, max_n: int) -> str:
    grams = []
    for side, col in (("p", "pt"), ("r", "rt")):
        parts = [f"""SELECT conv_id, turn, {n} AS n, array_to_string({col}[i:i + {n - 1}], ' ') AS gram
                     FROM tok, generate_series(1, len({col}) - {n - 1}) g(i) WHERE len({col}) >= {n}"""
                 for n in range(1, max_n + 1)]
        grams.append(f"c{side} AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM ("
                     + " UNION ALL ".join(parts) + ") GROUP BY ALL)")
    return f"""
tok AS (SELECT conv_id, turn, {tok_expr_p} AS pt, {tok_expr_r} AS rt FROM pairs),
{grams[0]},
{grams[1]},
mt AS (SELECT cp.conv_id, cp.turn, cp.n, sum(least(cp.c, cr.c)) AS matches
       FROM cp JOIN cr USING (conv_id, turn, n, gram) GROUP BY ALL),
ln AS (SELECT conv_id, turn, g.n, len(pt) AS lp, len(rt) AS lr,
              greatest(len(pt) - g.n + 1, 0) AS pred_ngrams, greatest(len(rt) - g.n + 1, 0) AS ref_ngrams
       FROM tok, generate_series(1, {max_n}) g(n)),
ov AS (SELECT ln.*, coalesce(mt.matches, 0) AS matches FROM ln LEFT JOIN mt USING (conv_id, turn, n))"""


ROUGE_TOK = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
BLEU_TOK = ("list_filter(string_split_regex(trim(regexp_replace({c}, '([^\\p{{L}}\\p{{N}}\\s_])', ' \\1 ', 'g')), "
            "'\\s+'), lambda x: x <> '')")


@register("text_rouge_12", "WITH " + PAIRS_SQL + "," + _ngram_sql(
    ROUGE_TOK.format(c="prediction"), ROUGE_TOK.format(c="reference"), 2) + """,
f AS (SELECT n, CASE WHEN pred_ngrams > 0 THEN matches::DOUBLE / pred_ngrams ELSE 0.0::DOUBLE END AS p,
             CASE WHEN ref_ngrams > 0 THEN matches::DOUBLE / ref_ngrams ELSE 0.0::DOUBLE END AS r FROM ov)
SELECT """ + O.rh("avg(CASE WHEN n = 1 THEN (CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END) END)")
          + " AS rouge1, " + O.rh("avg(CASE WHEN n = 2 THEN (CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END) END)")
          + " AS rouge2 FROM f")
def q_rouge(spark, sf):
    return TX.rouge_n(W.text_pairs(spark, sf), ["conv_id", "turn"]).select(r6("rouge1"), r6("rouge2"))


@register("text_rouge_l", None)
def q_rouge_l(spark, sf):
    return TX.rouge_l(W.text_pairs(spark, sf), ["conv_id", "turn"]).select(r6("rougeL"))


@register("text_bleu_corpus", "WITH " + PAIRS_SQL + "," + _ngram_sql(
    BLEU_TOK.format(c="prediction"), BLEU_TOK.format(c="reference"), 4) + """,
pn AS (SELECT n, sum(matches) AS m, sum(pred_ngrams) AS t FROM ov GROUP BY n),
lens AS (SELECT sum(lp) AS c, sum(lr) AS r FROM ov WHERE n = 1),
lg AS (SELECT sum(CASE WHEN m > 0 AND t > 0 THEN ln(m::DOUBLE / t) END) AS slog, min(CASE WHEN t > 0 THEN m END) AS minm,
              count(*) AS nn FROM pn),
bp AS (SELECT c, r, CASE WHEN c >= r THEN 1.0::DOUBLE WHEN c > 0 THEN exp(1 - r::DOUBLE / c) ELSE 0.0::DOUBLE END AS bp FROM lens)
SELECT """ + O.rh("CASE WHEN minm > 0 AND nn = 4 THEN 100.0::DOUBLE * bp * exp(slog / 4.0::DOUBLE) ELSE 0.0::DOUBLE END")
          + " AS bleu_score, " + O.rh("bp") + " AS brevity_penalty, CAST(c AS BIGINT) AS sys_len, CAST(r AS BIGINT) AS ref_len FROM lg, bp")
def q_bleu(spark, sf):
    b = TX.corpus_bleu(W.text_pairs(spark, sf), ["conv_id", "turn"])
    return b.select(r6("bleu_score"), r6("brevity_penalty"), F.col("sys_len").cast("long").alias("sys_len"),
                    F.col("ref_len").cast("long").alias("ref_len"))


def _tok_13a(c: str) -> str:
    """The 13a tokens of a text column in SQL."""
    for old, new in TX.TEXT_13A:
        old, new = (x.replace("\n", "' || chr(10) || '") for x in (old, new))
        c = f"replace({c}, '{old}', '{new}')"
    c = f"(' ' || {c} || ' ')"
    for pattern, new in TX.SPLIT_13A:
        new = new.replace("{1}", "\\1").replace("{2}", "\\2")
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


@register("text_bleu_13a", "WITH " + PAIRS_SQL + "," + _ngram_sql(_tok_13a("prediction"), _tok_13a("reference"), 4) + """,
g AS (SELECT n, sum(matches) AS m, sum(pred_ngrams) AS t FROM ov GROUP BY n),
z AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS zeros FROM g),
lg AS (SELECT sum(ln(CASE WHEN m > 0 THEN m::DOUBLE ELSE pow(2.0::DOUBLE, -zeros::DOUBLE) END / t)) AS logs,
              min(t) AS mint, max(m) AS maxm FROM z WHERE t > 0),
l AS (SELECT CAST(sum(lp) AS BIGINT) AS c, CAST(sum(lr) AS BIGINT) AS r FROM ov WHERE n = 1),
bp AS (SELECT c, r, CASE WHEN c >= r THEN 1.0::DOUBLE WHEN c > 0 THEN exp(1 - r::DOUBLE / c) ELSE 0.0::DOUBLE END AS bp FROM l)
SELECT """ + O.rh("CASE WHEN (SELECT min(t) FROM g) > 0 AND maxm > 0 THEN 100.0::DOUBLE * bp * exp(logs / 4.0::DOUBLE) ELSE 0.0::DOUBLE END")
          + " AS bleu_score, " + O.rh("bp") + " AS brevity_penalty, c AS sys_len, r AS ref_len FROM lg, bp")
def q_bleu_13a(spark, sf):
    return TX.corpus_bleu_smoothed(W.text_pairs(spark, sf), ["conv_id", "turn"]).select(
        r6("bleu_score"), r6("brevity_penalty"), F.col("sys_len").cast("long").alias("sys_len"), F.col("ref_len").cast("long").alias("ref_len"))


@register("text_rouge_stemmed", None)
def q_rouge_stemmed(spark, sf):
    """A20 with stemmed tokens: ROUGE-1, -2 and -L."""
    pairs, keys = W.text_pairs(spark, sf), ["conv_id", "turn"]
    n = TX.rouge_n(pairs, keys, TX.rouge_tokens_stemmed)
    return n.join(F.broadcast(TX.rouge_l(pairs, keys, TX.rouge_tokens_stemmed))).select(r6("rouge1"), r6("rouge2"), r6("rougeL"))


@register("text_eval_score_nlp", None)
def q_nlp_eval(spark, sf):
    """T1 for an NLP pair: BLEU/100 (Q4) and the ROUGE mean."""
    pairs = W.text_pairs(spark, sf)
    b = TX.corpus_bleu(pairs, ["conv_id", "turn"]).select((F.col("bleu_score") / 100.0).alias("bleu_score"))
    r = TX.rouge_n(pairs, ["conv_id", "turn"])
    rl = TX.rouge_l(pairs, ["conv_id", "turn"])
    j = (b.withColumn("_k", F.lit(1)).join(r.withColumn("_k", F.lit(1)), "_k")
          .join(rl.withColumn("_k", F.lit(1)), "_k").drop("_k"))
    return E.eval_score_columns(j.withColumn("model_type", F.lit("nlp")))


# ---------------------------------------------------------- attribution

PART_WEIGHTS = {"p_size": 120.0, "p_retailprice": 0.8}


@register("attribution_linear_global", """
WITH m AS (SELECT avg(p_size::DOUBLE) AS ms, avg(p_retailprice) AS mr FROM part),
c AS (SELECT 'p_size' AS feature, 0 AS feature_ord, 120.0::DOUBLE * (p_size::DOUBLE - ms) AS contribution FROM part, m
      UNION ALL SELECT 'p_retailprice', 1, 0.8::DOUBLE * (p_retailprice - mr) FROM part, m),
g AS (SELECT feature, feature_ord, avg(abs(contribution)) AS importance, max(abs(contribution)) AS max_abs FROM c GROUP BY ALL)
SELECT feature, feature_ord, """ + O.rh("importance") + " AS importance, " + O.rh("max_abs") + """ AS max_abs,
       row_number() OVER (ORDER BY importance DESC, feature_ord) AS rank FROM g""")
def q_attr_linear(spark, sf):
    c = AT.linear_attribution(table(spark, sf, "part"), "p_partkey", PART_WEIGHTS)
    g = AT.global_summary(c)
    return g.select("feature", "feature_ord", r6("importance"), r6("max_abs"), "rank")


@register("attribution_importance_coverage", """
WITH m AS (SELECT avg(p_size::DOUBLE) AS ms, avg(p_retailprice) AS mr FROM part),
c AS (SELECT 'p_size' AS feature, 0 AS feature_ord, 120.0::DOUBLE * (p_size::DOUBLE - ms) AS contribution FROM part, m
      UNION ALL SELECT 'p_retailprice', 1, 0.8::DOUBLE * (p_retailprice - mr) FROM part, m),
g AS (SELECT feature, feature_ord, avg(abs(contribution)) AS importance FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature_ord) AS rank FROM g)
SELECT """ + O.rh("sum(CASE WHEN rank <= 1 THEN importance ELSE 0.0::DOUBLE END) / sum(importance)")
           + " AS coverage, count(*) AS n_features FROM r")
def q_coverage(spark, sf):
    g = AT.global_summary(AT.linear_attribution(table(spark, sf, "part"), "p_partkey", PART_WEIGHTS))
    return AT.importance_coverage(g, 1).select(r6("coverage"), "n_features")


RULE_FEATURES = ["o_totalprice", "c_acctbal"]


def _rule(x):
    """A non-linear rule model over two features."""
    return F.when((x["o_totalprice"] > 200000) & (x["c_acctbal"] > 5000), 1.0).otherwise(0.0)


def _rule_sql(price: str, acct: str) -> str:
    return f"CASE WHEN {price} > 200000 AND {acct} > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


# both orders of two features against each of the 50 background rows
SHAPLEY_SQL = "WITH " + O.ORDERS_DS + f""",
x AS (SELECT row_id, o_totalprice::DOUBLE AS p, c_acctbal::DOUBLE AS a FROM ds),
bg AS (SELECT p AS bp, a AS ba FROM x ORDER BY md5('42' || row_id), row_id LIMIT 50),
c AS (SELECT row_id, any_value(p) AS p, any_value(a) AS a, any_value({_rule_sql('p', 'a')}) AS prediction,
             avg({_rule_sql('bp', 'ba')}) AS base_value,
             avg(({_rule_sql('p', 'ba')} - {_rule_sql('bp', 'ba')} + {_rule_sql('p', 'a')} - {_rule_sql('bp', 'a')}) / 2) AS c0,
             avg(({_rule_sql('bp', 'a')} - {_rule_sql('bp', 'ba')} + {_rule_sql('p', 'a')} - {_rule_sql('p', 'ba')}) / 2) AS c1
      FROM x, bg GROUP BY row_id),
l AS (SELECT row_id, prediction, base_value, 'o_totalprice' AS feature, 0 AS feature_ord, p AS value, c0 AS contribution FROM c
      UNION ALL SELECT row_id, prediction, base_value, 'c_acctbal', 1, a, c1 FROM c),
g AS (SELECT feature, feature_ord, avg(abs(contribution)) AS importance, max(abs(contribution)) AS max_abs FROM l GROUP BY ALL)
"""


@register("attribution_shapley_rule", SHAPLEY_SQL + "SELECT feature, feature_ord, " + O.rh("importance") + " AS importance, "
          + O.rh("max_abs") + " AS max_abs, row_number() OVER (ORDER BY importance DESC, feature_ord) AS rank FROM g")
def q_shapley(spark, sf):
    c = AT.shapley_sample(W.orders_dataset(spark, sf), "row_id", RULE_FEATURES, _rule)
    return AT.global_summary(c).select("feature", "feature_ord", r6("importance"), r6("max_abs"), "rank")


@register("attribution_shapley_rows", SHAPLEY_SQL + "SELECT row_id, prediction, " + O.rh("base_value") + " AS base_value, feature, "
          + O.rh("value") + " AS value, " + O.rh("contribution") + """ AS contribution,
       row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature_ord) AS "order" FROM l""")
def q_shapley_rows(spark, sf):
    """X7 of every row: prediction, base value, contributions by size."""
    wide = AT.shapley_wide(W.orders_dataset(spark, sf), "row_id", RULE_FEATURES, _rule)
    e = AT.ordered_contributions(wide, "row_id", RULE_FEATURES)
    return e.select("row_id", "prediction", r6("base_value"), "feature", r6("value"), r6("contribution"), "order")


@register("attribution_explanation_record", SHAPLEY_SQL + """,
f AS (SELECT feature, string_agg(CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT), ',' ORDER BY row_id) AS first_values,
             string_agg(CAST(floor(contribution * 1000000 + 0.5::DOUBLE) AS BIGINT), ',' ORDER BY row_id) AS first_contributions
      FROM l WHERE row_id IN (SELECT row_id FROM x ORDER BY row_id LIMIT 5) GROUP BY feature)
SELECT row_number() OVER (ORDER BY importance DESC, feature_ord) AS rank,
       row_number() OVER (ORDER BY importance DESC, feature_ord) <= 5 AS in_top, feature, feature_ord, """
          + O.rh("importance") + " AS importance, " + O.rh("(SELECT avg(abs(contribution)) FROM l)") + " AS overall_mean, "
          + O.rh("(SELECT max(abs(contribution)) FROM l)") + " AS overall_max, " + O.rh("(SELECT any_value(base_value) FROM l)")
          + """ AS base_value, (SELECT count(*) FROM x) AS n_rows, 2 AS n_features, first_values, first_contributions
FROM g JOIN f USING (feature)""")
def q_explanation_record(spark, sf):
    """X1 in full: importances with the overall figures, the base value and the first rows' values."""
    wide = AT.shapley_wide(W.orders_dataset(spark, sf), "row_id", RULE_FEATURES, _rule)
    e = AT.explanation_record(wide, "row_id", RULE_FEATURES)
    listed = (lambda c, k: F.concat_ws(",", F.transform(c, lambda v: F.floor(v * float(k) + 0.5).cast("string"))).alias(c))
    return e.select("rank", "in_top", "feature", "feature_ord", r6("importance"), r6("overall_mean"), r6("overall_max"),
                    r6("base_value"), "n_rows", "n_features", listed("first_values", 100), listed("first_contributions", 1000000))


@register("attribution_method", "WITH " + SR.registry_with("models") + """,
f AS (SELECT model_id, model_type, CASE regexp_extract(lower(file_path), '(\\.[a-z0-9]+)$', 1) WHEN '.pkl' THEN 'sklearn'
        WHEN '.joblib' THEN 'sklearn' WHEN '.pt' THEN 'pytorch' WHEN '.pth' THEN 'pytorch' WHEN '.h5' THEN 'keras'
        WHEN '.onnx' THEN 'onnx' END AS framework FROM models)
SELECT model_id, framework, CASE WHEN framework = 'sklearn' AND model_type = 'regression' THEN 'linear_shapley'
         WHEN framework = 'onnx' THEN 'permutation_shapley' WHEN framework IN ('pytorch', 'keras') THEN 'local_surrogate'
         WHEN framework = 'sklearn' THEN 'native_importance' ELSE 'none' END AS method FROM f""")
def q_method(spark, sf):
    """The way each registered model is explained, from what its framework offers."""
    m = SR.models(spark, sf)
    fw = RG.framework_of(F.col("file_path"))
    m = m.select("model_id", fw.alias("framework"), "model_type").select(
        "*", ((F.col("framework") == "sklearn") & (F.col("model_type") == "regression")).alias("has_linear_weights"),
        (F.col("framework") == "onnx").alias("has_expression"), F.col("framework").isin("pytorch", "keras").alias("can_perturb"),
        (F.col("framework") == "sklearn").alias("has_native"))
    return AT.choose_method(m).select("model_id", "framework", "method")


@register("attribution_explain_one", """
WITH m AS (SELECT avg(p_size::DOUBLE) AS ms, avg(p_retailprice) AS mr FROM part),
c AS (SELECT p_partkey, 120.0::DOUBLE * ms + 0.8::DOUBLE * mr AS base_value, 'p_size' AS feature, 0 AS feature_ord,
             p_size::DOUBLE AS value, 120.0::DOUBLE * (p_size::DOUBLE - ms) AS contribution FROM part, m WHERE p_partkey = 1
      UNION ALL
      SELECT p_partkey, 120.0::DOUBLE * ms + 0.8::DOUBLE * mr, 'p_retailprice', 1, p_retailprice,
             0.8::DOUBLE * (p_retailprice - mr) FROM part, m WHERE p_partkey = 1)
SELECT p_partkey, """ + O.rh("base_value") + """ AS base_value, feature, feature_ord, """ + O.rh("value") + """ AS value,
       """ + O.rh("contribution") + """ AS contribution,
       row_number() OVER (ORDER BY abs(contribution) DESC, feature_ord) AS "order" FROM c""")
def q_explain_one(spark, sf):
    c = AT.linear_attribution(table(spark, sf, "part"), "p_partkey", PART_WEIGHTS)
    e = AT.explain_one(c, "p_partkey", 1)
    return e.select("p_partkey", r6("base_value"), "feature", "feature_ord", r6("value"), r6("contribution"), "order")


@register("attribution_native_importance", None)
def q_native_importance(spark, sf):
    """Importances that fitted models carry (absolute weights, impurity decrease), all order rows."""
    from trustframe.operators import models as M
    rows, names = M.prepared(W.orders_dataset(spark, sf).select("row_id", *X.FEATURES, "target"), "target",
                             ["o_totalprice", "c_acctbal"], ["o_orderpriority", "c_mktsegment", "n_regionkey"])
    out = None
    for a in ("LogisticRegression", "RandomForest"):
        t = M.native_importance(spark, M.fit(rows, a), names).select(F.lit(a).alias("model_id"), "feature", r6("importance"), "rank")
        out = t if out is None else out.unionByName(t)
    return out


# ---------------------------------------------------------- preparation


@register("prep_label_index", """
SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS priority_idx, count(*) AS n
FROM orders GROUP BY o_orderpriority""")
def q_label_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority")
    return PR.label_index(o, "o_orderpriority", "priority_idx").groupBy("o_orderpriority", "priority_idx").agg(
        F.count(F.lit(1)).alias("n"))


@register("prep_one_hot_binarise", """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE 'Other' END AS seg_bin,
       CAST(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END) AS BIGINT) AS oh_automobile,
       CAST(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS oh_machinery, count(*) AS n
FROM customer GROUP BY ALL""")
def q_one_hot(spark, sf):
    c = table(spark, sf, "customer")
    oh = PR.one_hot(c, "c_mktsegment", PR.categories(c, "c_mktsegment"), drop_first=False)
    return (oh.withColumn("seg_bin", PR.binarise(F.col("c_mktsegment"), "BUILDING"))
              .groupBy("seg_bin").agg(F.sum("c_mktsegment_AUTOMOBILE").cast("long").alias("oh_automobile"),
                                      F.sum("c_mktsegment_MACHINERY").cast("long").alias("oh_machinery"),
                                      F.count(F.lit(1)).alias("n")))


@register("prep_cohort_filter", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def q_cohort(spark, sf):
    return PR.conjunctive_filter(table(spark, sf, "orders"), {"o_totalprice": (100000, 300000)},
                                 {"o_orderstatus": ["P"], "o_orderpriority": ["5-LOW"]},
                                 ["o_orderkey", "o_totalprice"])


def _impute_sql(c: str, numeric: bool) -> str:
    fill = (f"(SELECT quantile_cont({c}, 0.5) FROM inj)" if numeric else
            f"(SELECT {c} FROM inj WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")
    shown = f"({O.rh(fill, 2)})::VARCHAR" if numeric else fill
    return (f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS filled, {shown} AS fill, "
            f"count(*) FILTER (WHERE coalesce({c}, {fill}) = {fill}) AS rows_with_fill, 0::BIGINT AS nulls_left FROM inj")


_IMPUTE = [("o_totalprice", True), ("c_acctbal", True), ("o_orderpriority", False), ("c_mktsegment", False),
           ("n_regionkey", False)]


@register("prep_impute", "WITH " + O.ORDERS_DS + """,
inj AS (SELECT row_id, target, """ + ", ".join(f"CASE WHEN {_U.format(c=c)} < 0.1::DOUBLE THEN NULL ELSE {c} END AS {c}" for c, _ in _IMPUTE) + """ FROM ds)
""" + "\nUNION ALL\n".join(_impute_sql(c, n) for c, n in _IMPUTE))
def q_impute(spark, sf):
    """M2: what was filled, with what, and how many rows hold the fill afterwards."""
    ds = W.orders_dataset(spark, sf).select("row_id", *X.FEATURES, "target")
    d = X.inject_nulls(ds, "row_id", ["target"], 0.1)
    d = d.select("*", *[F.col(c).isNull().alias(f"was_{c}") for c, _ in _IMPUTE])
    f = PR.impute(d, [c for c, n in _IMPUTE if n], [c for c, n in _IMPUTE if not n], [])
    one = f.agg(*[x for c, n in _IMPUTE for x in (
        F.sum(F.col(f"was_{c}").cast("long")).alias(f"filled_{c}"), F.max(F.when(F.col(f"was_{c}"), F.col(c))).alias(f"fill_{c}"),
        F.count(F.when(F.col(c).isNull(), 1)).alias(f"left_{c}"))])
    j = f.withColumn("_j", F.lit(1)).join(F.broadcast(one.withColumn("_j", F.lit(1))), "_j")  # one row
    same = j.agg(*[F.count(F.when(F.col(c) == F.col(f"fill_{c}"), 1)).alias(f"same_{c}") for c, _ in _IMPUTE],
                 *[F.first(f"{k}_{c}").alias(f"{k}_{c}") for c, _ in _IMPUTE for k in ("filled", "fill", "left")])
    return same.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"filled_{c}").alias("filled"),
                 (r6(f"fill_{c}", 2).cast("string") if n else F.col(f"fill_{c}")).alias("fill"),
                 F.col(f"same_{c}").alias("rows_with_fill"), F.col(f"left_{c}").alias("nulls_left")) for c, n in _IMPUTE])).alias("x")).select("x.*")


@register("model_train_logistic", None)
def q_train(spark, sf):
    """M3 + M4: MLlib logistic regression on the positional split, then the
    standard metrics of its test predictions."""
    from trustframe.operators.metrics import classification_metrics
    from trustframe.operators.splits import positional_split
    ds = positional_split(W.orders_dataset(spark, sf), [], ["row_id"])
    tr, te = ds.filter(F.col("split") == "train"), ds.filter(F.col("split") == "test")
    scored = PR.train_and_score(tr, te, "target", ["o_totalprice", "c_acctbal"],
                                ["o_orderpriority", "c_mktsegment", "n_regionkey"])
    p = scored.select(F.lit("mllib_logistic").alias("model_id"), F.lit("orders_status").alias("dataset_id"),
                      F.col("target").cast("double").alias("y_true"), "y_pred")
    return classification_metrics(p)


# ------------------------------------------------------ checks and extras

_INV_COLS = ["P", "H", "F", "R", "beta_performance", "beta_health", "beta_fairness", "beta_robustness",
             "trust_score", "DII", "dp_value", "delta"]


@register("trust_invariants", O.evaluation_ctes("lineitem_price") + """
SELECT model_id, dataset_id, trust_mode, """ + ", ".join(_INV_COLS) + """ FROM tr
WHERE NOT (P BETWEEN 0 AND 1 AND H BETWEEN 0 AND 1 AND F BETWEEN 0 AND 1 AND R BETWEEN 0 AND 1
  AND beta_performance BETWEEN 0 AND 1 AND beta_health BETWEEN 0 AND 1 AND beta_fairness BETWEEN 0 AND 1
  AND beta_robustness BETWEEN 0 AND 1
  AND abs(beta_performance + beta_health + beta_fairness + beta_robustness - 1) < 1e-6
  AND trust_score BETWEEN 0 AND 100 AND DII BETWEEN 0 AND 1 AND dp_value BETWEEN 0 AND 1 AND delta BETWEEN 0 AND 1)""")
def q_invariants(spark, sf):
    """Rows breaking a scorer invariant (expected: none)."""
    from trustframe.functions.trust import invariant_violations
    return invariant_violations(E.evaluate_workload(spark, sf, "lineitem_price"), K)


@register("trust_earlier_meta_score", O.evaluation_ctes("orders_status") + """,
v0 AS (SELECT model_id, dataset_id,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - (least(coalesce(missing_values, 0)::DOUBLE / greatest(coalesce(n_rows, 1), 1) * 100, 30.0::DOUBLE)
     + CASE WHEN coalesce(imbalance_ratio, 0.5::DOUBLE) > 0.6::DOUBLE THEN (coalesce(imbalance_ratio, 0.5::DOUBLE) - 0.5::DOUBLE) * 80 ELSE 0.0::DOUBLE END
     + CASE WHEN greatest(coalesce(n_rows, 1), 1) < 100 THEN (1 - greatest(coalesce(n_rows, 1), 1)::DOUBLE / 100) * 20 ELSE 0.0::DOUBLE END
     + coalesce(low_variance_fraction, 0.0::DOUBLE) * 10))) AS h,
  coalesce(f1_score, 0.0::DOUBLE) * 100 AS p,
  CASE WHEN abs(train_f1_score - f1_score) > 0.1::DOUBLE THEN -abs(train_f1_score - f1_score) * 100 * 0.3::DOUBLE ELSE 0.0::DOUBLE END AS adj
  FROM inp)
SELECT model_id, dataset_id, """ + O.rh("h") + " AS dataset_health_score_v0, "
    + O.rh("greatest(0.0::DOUBLE, least(0.65::DOUBLE * p + 0.25::DOUBLE * h + 0.10::DOUBLE * (100 + adj), 100.0::DOUBLE))", 2)
    + " AS meta_score_v0 FROM v0")
def q_meta_v0(spark, sf):
    """The earlier documented meta score."""
    from trustframe.functions.trust import earlier_meta_score
    m = earlier_meta_score(E.evaluation_inputs(spark, sf, E.WORKLOADS["orders_status"]))
    return m.select(*K, r6("dataset_health_score_v0"), r6("meta_score_v0"))


def _surrogate_sql() -> str:
    """The same draws; the 3 x 3 system of two features and an intercept by Cramer's rule."""
    (a0, a1), (h0, h1) = AT.lattice(2, "42")
    v = _rule_sql("p + z0 * s0", "a + z1 * s1")
    return "WITH " + O.ORDERS_DS + f""",
x AS (SELECT row_id, o_totalprice::DOUBLE AS p, c_acctbal::DOUBLE AS a FROM ds),
st AS (SELECT stddev_samp(p) AS s0, stddev_samp(a) AS s1 FROM x),
u AS (SELECT j, j * {O.d(a0)} + {O.d(h0)} AS u0, j * {O.d(a1)} + {O.d(h1)} AS u1 FROM range(1000) t(j)),
z AS (SELECT j, CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE sqrt(-2 * ln(1 - (u0 - floor(u0)))) * cos(2 * pi() * (u1 - floor(u1))) END AS z0,
             CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE sqrt(-2 * ln(1 - (u0 - floor(u0)))) * sin(2 * pi() * (u1 - floor(u1))) END AS z1 FROM u),
w AS (SELECT *, exp(-(z0 * z0 + z1 * z1) / (0.5625::DOUBLE * 2)) AS w FROM z),
n AS (SELECT sum(w) AS n00, sum(w * z0) AS n01, sum(w * z1) AS n02, sum(w * z0 * z0) + 1 AS n11, sum(w * z0 * z1) AS n12,
             sum(w * z1 * z1) + 1 AS n22 FROM w),
b AS (SELECT row_id, sum(w * y) AS b0, sum(w * z0 * y) AS b1, sum(w * z1 * y) AS b2
      FROM (SELECT row_id, w, z0, z1, {v} AS y FROM x, st, w) GROUP BY row_id),
c AS (SELECT row_id,
        (n00 * (b1 * n22 - n12 * b2) - b0 * (n01 * n22 - n12 * n02) + n02 * (n01 * b2 - b1 * n02)) / det AS c0,
        (n00 * (n11 * b2 - b1 * n12) - n01 * (n01 * b2 - b1 * n02) + b0 * (n01 * n12 - n11 * n02)) / det AS c1
      FROM b, (SELECT *, n00 * (n11 * n22 - n12 * n12) - n01 * (n01 * n22 - n12 * n02) + n02 * (n01 * n12 - n11 * n02) AS det FROM n)),
g AS (SELECT 'o_totalprice' AS feature, 0 AS feature_ord, avg(abs(c0)) AS importance, max(abs(c0)) AS max_abs FROM c
      UNION ALL SELECT 'c_acctbal', 1, avg(abs(c1)), max(abs(c1)) FROM c)
SELECT feature, feature_ord, {O.rh("importance")} AS importance, {O.rh("max_abs")} AS max_abs,
       row_number() OVER (ORDER BY importance DESC, feature_ord) AS rank FROM g"""


@register("attribution_local_surrogate", _surrogate_sql())
def q_surrogate(spark, sf):
    """X4 with a rule model; mean |coefficient| per feature, ranked."""
    c = AT.local_surrogate(W.orders_dataset(spark, sf), "row_id", RULE_FEATURES, _rule)
    g = AT.global_summary(c.withColumnRenamed("coefficient", "contribution"))
    return g.select("feature", "feature_ord", r6("importance"), r6("max_abs"), "rank")


@register("prep_align_columns", """
SELECT CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS "o_orderpriority_1-URGENT",
       CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS "o_orderpriority_2-HIGH",
       CAST(0 AS BIGINT) AS "o_orderpriority_6-NONE",
       CAST(sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS o_orderpriority_nan
FROM orders""")
def q_align(spark, sf):
    """One-hot columns aligned to a reference list that has an unseen
    category (filled with 0); the null indicator is kept."""
    o = table(spark, sf, "orders")
    oh = PR.one_hot(o, "o_orderpriority", ["1-URGENT", "2-HIGH"], drop_first=False, null_indicator=True)
    al = PR.align_columns(oh, ["o_orderpriority_1-URGENT", "o_orderpriority_2-HIGH", "o_orderpriority_6-NONE"])
    return al.agg(*[F.sum(F.col(f"`{c}`")).cast("long").alias(c) for c in al.columns])


@register("insights_top_pairs_lineitem", """
WITH u AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, {i} AS i, {i + 1 + k} AS j, corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                           "l_discount", "l_tax"])
    for k, b in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                           "l_discount", "l_tax"][i + 1:])) + """)
SELECT feature1, feature2, """ + O.rh("abs(r)", 4) + """ AS abs_correlation FROM u
ORDER BY """ + O.rh("abs(r)", 4) + """ DESC, i, j LIMIT 10""")
def q_top_pairs(spark, sf):
    """K3: the strongest pairs (top 10 by |r|)."""
    from trustframe.operators.insights import pearson_pairs
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
    p = pearson_pairs(table(spark, sf, "lineitem").select(*cols), 0.0)
    return (p.orderBy(F.col("abs_correlation").desc(), "i", "j").limit(10)
             .select("feature1", "feature2", "abs_correlation"))


@register("experiment_ttest_modes_statistic", O.fold_results_sql() + """
SELECT model_id, count(*) AS n, """ + O.rh("avg(trust_balanced - trust_strict)") + " AS mean_diff, "
          + O.rh("stddev_samp(trust_balanced - trust_strict)") + " AS sd_diff, "
          + O.rh("avg(trust_balanced - trust_strict) / (stddev_samp(trust_balanced - trust_strict) / sqrt(count(*)))")
          + " AS t_stat FROM fr GROUP BY model_id")
def q_ttest_stat(spark, sf):
    """The paired t statistic of balanced vs strict per model (the
    p-value is in ``experiment_ttest_modes``)."""
    t = X.balanced_vs_strict(X.fold_results(spark, sf))
    return t.select("model_id", "n", r6("mean_diff"), r6("sd_diff"), r6("t_stat"))


@register("experiment_correlation_r", O.fold_results_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, " + O.rh(f"corr({x}, {y})") + " AS r FROM fr"
    for x, y in _CORR_PAIRS))
def q_corr_r(spark, sf):
    """Pearson r over all folds and models (p-values in ``experiment_correlation``)."""
    f = X.fold_results(spark, sf)
    out = None
    for x, y in _CORR_PAIRS:
        c = X.correlation_p(f, x, y).select("x", "y", "n", r6("r"))
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------------------ fitted models

@register("experiment_fitted_folds", None)
def q_fitted_folds(spark, sf):
    """M3 + A25: fold results of fitted logistic regression, forest and boosted trees."""
    return X.fitted_fold_results(spark, sf).select("model_id", "fold", *[r6(c) for c in ("accuracy", "f1_score", "dp", "trust_balanced", "trust_strict")])


@register("experiment_fitted_summary", None)
def q_fitted_summary(spark, sf):
    """A25 with A26 (both modes within a model) and A27 (accuracy against trust) for the fitted models."""
    folds = X.fitted_fold_results(spark, sf)
    t = X.balanced_vs_strict(folds).select("model_id", "t_stat", "p_value", "significance")
    r = X.correlation_p(folds, "accuracy", "trust_balanced", ["model_id"]).select("model_id", F.col("r").alias("accuracy_trust_r"))
    return X.fold_summary(folds).join(t, "model_id").join(r, "model_id")


# ------------------------------------------------------ guarded JSON (fn-json), F13

#: documents of every kind made from events.props: as given, cut off, in an array, missing, nested, a text for the number, bare
_DOC_SPARK = """CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN substring(props, 1, length(props) - 1) WHEN 2 THEN concat('[', props, ']') WHEN 3 THEN CAST(NULL AS STRING)
  WHEN 4 THEN concat('{"metadata": ', props, '}') WHEN 5 THEN concat('{"metadata": {"k": "', event_type, '"}, "k": null}') ELSE '7' END"""
_DOC_SQL = """CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN substring(props, 1, length(props) - 1) WHEN 2 THEN concat('[', props, ']') WHEN 3 THEN NULL
  WHEN 4 THEN concat('{"metadata": ', props, '}') WHEN 5 THEN concat('{"metadata": {"k": "', event_type, '"}, "k": null}') ELSE '7' END"""
_NUMERIC = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"


@register("json_guarded_reads", f"""
WITH d AS (SELECT event_type, CASE WHEN json_valid({_DOC_SQL}) THEN {_DOC_SQL} END AS doc FROM events)
SELECT event_type, CASE json_type(doc) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE CASE WHEN doc IS NOT NULL THEN 'scalar' END END AS kind,
  CASE WHEN json_type(doc, '$.metadata.k') = 'VARCHAR' THEN json_extract_string(doc, '$.metadata.k') END AS text, count(*) AS n,
  sum(CASE WHEN json_type(doc, '$.k') IN {_NUMERIC} THEN json_extract_string(doc, '$.k')::DOUBLE END) AS k_sum,
  sum(CASE WHEN json_type(doc, '$.metadata.k') IN {_NUMERIC} THEN json_extract_string(doc, '$.metadata.k')::DOUBLE END) AS nested_sum
FROM d GROUP BY ALL""")
def q_json(spark, sf):
    """fn-json: nested values of the right type out of well-formed, malformed, array, scalar and null documents."""
    from trustframe.functions.json import json_kind, json_number, json_text
    d = table(spark, sf, "events").select("event_type", F.expr(_DOC_SPARK).alias("doc"))
    return (d.groupBy("event_type", json_kind(F.col("doc")).alias("kind"), json_text(F.col("doc"), "metadata", "k").alias("text"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(json_number(F.col("doc"), "k")).alias("k_sum"), F.sum(json_number(F.col("doc"), "metadata", "k")).alias("nested_sum")))


_META = """CASE event_id % 5 WHEN 0 THEN '{"sensitive_attribute": "o_orderpriority"}' WHEN 1 THEN '{"sensitive_attribute": 5}' WHEN 2 THEN '{"sensitive_attribute": "unknown"}'
  WHEN 3 THEN '["o_orderpriority"]' END"""
_REQ = "CASE event_id % 7 WHEN 0 THEN 'c_mktsegment' WHEN 1 THEN 'missing_column' END"
_OWN = "CASE event_id % 3 WHEN 0 THEN 'n_regionkey' WHEN 1 THEN 'gone' END"
_ORDER_COLUMNS = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "n_regionkey"]


@register("fairness_resolved_attribute", "WITH " + f"""
rq AS (SELECT event_id, {_REQ} AS req, {_OWN} AS own, {_META} AS meta FROM events),
pk AS (SELECT CASE WHEN req IN ({", ".join(f"'{c}'" for c in _ORDER_COLUMNS)}) THEN req WHEN own IN ({", ".join(f"'{c}'" for c in _ORDER_COLUMNS)}) THEN own
         WHEN json_type(meta, '$.sensitive_attribute') = 'VARCHAR' AND json_extract_string(meta, '$.sensitive_attribute') IN ({", ".join(f"'{c}'" for c in _ORDER_COLUMNS)})
         THEN json_extract_string(meta, '$.sensitive_attribute') END AS asked FROM rq),
ds AS (SELECT o_orderkey, o_orderpriority, c_mktsegment, n_regionkey::VARCHAR AS n_regionkey, o_totalprice, o_orderstatus FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
found AS (SELECT 0 AS ordinal, 'o_orderpriority' AS attribute, count(DISTINCT o_orderpriority) AS n FROM ds UNION ALL SELECT 1, 'c_mktsegment', count(DISTINCT c_mktsegment) FROM ds
          UNION ALL SELECT 2, 'n_regionkey', count(DISTINCT n_regionkey) FROM ds),
auto AS (SELECT attribute FROM found WHERE n BETWEEN 2 AND 10 ORDER BY ordinal LIMIT 1),
used AS (SELECT coalesce(asked, (SELECT attribute FROM auto)) AS attribute, asked IS NULL AS detected, count(*) AS requests FROM pk GROUP BY ALL),
rates AS (SELECT attribute, grp, avg(CASE WHEN o_totalprice > 200000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ppr FROM (
            SELECT 'o_orderpriority' AS attribute, o_orderpriority AS grp, o_totalprice FROM ds UNION ALL SELECT 'c_mktsegment', c_mktsegment, o_totalprice FROM ds
            UNION ALL SELECT 'n_regionkey', n_regionkey, o_totalprice FROM ds) GROUP BY ALL)
SELECT attribute, detected, requests, {O.rh("(SELECT max(ppr) - min(ppr) FROM rates r WHERE r.attribute = used.attribute)")} AS dp FROM used""")
def q_resolved(spark, sf):
    """F13 before A10: each request's attribute from the request, the dataset or its JSON metadata, else
    the first that is detected; with the gap of positive rates over it for one model."""
    from trustframe.functions.json import json_text
    from trustframe.operators.fairness import detect_sensitive_attributes
    ds = W.orders_dataset(spark, sf)
    rq = table(spark, sf, "events").select(F.expr(_REQ).alias("req"), F.expr(_OWN).alias("own"), json_text(F.expr(_META), "sensitive_attribute").alias("meta"))
    asked = PR.resolve_attribute(F.array(*[F.lit(c) for c in _ORDER_COLUMNS]), F.col("req"), F.col("own"), F.col("meta"))
    auto = (detect_sensitive_attributes(ds.select(*_ORDER_COLUMNS), ["o_totalprice", "c_acctbal"]).agg(F.min_by("column", "ordinal").alias("first")))  # one row
    used = (rq.select(asked.alias("asked")).groupBy("asked").agg(F.count(F.lit(1)).alias("requests")).join(F.broadcast(auto))
            .select(F.coalesce("asked", "first").alias("attribute"), F.col("asked").isNull().alias("detected"), "requests"))
    p = ds.withColumn("pos", F.when(F.expr(W.BINARY_RULES["m_price"]), 1.0).otherwise(0.0))
    long = p.select("pos", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp")) for a in W.ORDER_ATTRS])).alias("x")).select("pos", "x.*")
    dp = (long.groupBy("attribute", "grp").agg(F.avg("pos").alias("ppr")).groupBy("attribute").agg((F.max("ppr") - F.min("ppr")).alias("dp")))
    return used.join(dp, "attribute", "left").select("attribute", "detected", "requests", r6("dp"))


@register("prep_stratified_split", "WITH " + O.ORDERS_DS + """,
p AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS k, count(*) OVER (PARTITION BY target) AS n FROM ds)
SELECT target, CASE WHEN k <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids
FROM p GROUP BY ALL""")
def q_stratified(spark, sf):
    """the orders' 70/30 split with each class's share kept."""
    from trustframe.operators.splits import stratified_split
    s = stratified_split(W.orders_dataset(spark, sf), [], "target", "row_id")
    return s.groupBy("target", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").cast("long").alias("ids"))


@register("prep_score_expression", """
SELECT p_partkey, """ + O.rh("120.0::DOUBLE * p_size + 0.8::DOUBLE * p_retailprice + 5.0::DOUBLE") + """ AS y_pred FROM part""")
def q_score_expression(spark, sf):
    """M4: a model given as an expression scores every part."""
    m = AT.linear_model(PART_WEIGHTS, 5.0)
    return PR.score_expression(table(spark, sf, "part"), m, list(PART_WEIGHTS)).select("p_partkey", r6("y_pred"))


@register("evaluation_bands", O.evaluation_ctes("docs_quality") + """
SELECT model_id, dataset_id, trust_mode,
       CASE WHEN trust_score >= 70 THEN 'High Trust' WHEN trust_score >= 40 THEN 'Moderate Trust' WHEN trust_score IS NOT NULL THEN 'Low Trust' END AS trust_band,
       CASE WHEN DII <= 0.15::DOUBLE THEN 1 WHEN DII <= 0.30::DOUBLE THEN 2 WHEN DII <= 0.50::DOUBLE THEN 3 WHEN DII IS NOT NULL THEN 4 END AS dii_band FROM tr""")
def q_bands(spark, sf):
    """Bands of trust and instability."""
    from trustframe.operators.fairness import dii_band, trust_band
    e = E.evaluate_workload(spark, sf, "docs_quality")
    return e.select(*K, "trust_mode", trust_band(F.col("trust_score")).alias("trust_band"), dii_band(F.col("DII")).alias("dii_band"))
