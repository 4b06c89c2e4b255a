"""Registered registry / cache / listing / history / window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustframe.functions.expr import round_half
from trustframe.operators import registry as RG
from trustframe.operators.events import rate_window
from trustframe.plans import oracle as O
from trustframe.plans.catalog import register
from trustframe.sources import registered as RD
from trustframe.sources import registry as SR
from trustframe.sources.tables import table

NOW = "2001-10-01 00:00:00"
TS = "yyyy-MM-dd HH:mm:ss"
DTS = "%Y-%m-%d %H:%M:%S"


def r6(c, n=6):
    return round_half(F.col(c).cast("double"), n).alias(c)


def W(*names):
    return "WITH " + SR.registry_with(*names)


@register("leaderboard", W("models", "evaluations") + f"""
SELECT e.dataset_id, row_number() OVER (PARTITION BY e.dataset_id ORDER BY e.eval_score DESC, e.model_id) AS rank,
       e.model_id, m.name AS model_name, m.model_type, {O.rh('e.eval_score')} AS eval_score
FROM evaluations e LEFT JOIN models m USING (model_id)""")
def q_leaderboard(spark, sf):
    lb = RG.leaderboard(SR.evaluations(spark, sf), SR.models(spark, sf))
    return lb.select("dataset_id", "rank", "model_id", "model_name", "model_type", r6("eval_score"))


@register("trust_ranking", W("evaluations") + f"""
SELECT row_number() OVER (ORDER BY coalesce(trust_score, eval_score) DESC, model_id, dataset_id) AS rank,
       model_id, dataset_id, {O.rh('coalesce(trust_score, eval_score)')} AS rank_score
FROM evaluations""")
def q_trust_ranking(spark, sf):
    return RG.trust_ranking(SR.evaluations(spark, sf)).select("rank", "model_id", "dataset_id", r6("rank_score"))


@register("registry_history", W("models", "datasets", "evaluations") + f"""
SELECT e.model_id, e.dataset_id, m.name AS model_name, d.name AS dataset_name, {O.rh('e.eval_score')} AS eval_score,
       strftime(e.evaluated_at, '{DTS}') AS evaluated_at
FROM evaluations e LEFT JOIN models m USING (model_id) LEFT JOIN datasets d USING (dataset_id)
ORDER BY e.evaluated_at DESC, e.model_id, e.dataset_id LIMIT 50""")
def q_history(spark, sf):
    h = RG.history(SR.evaluations(spark, sf), SR.models(spark, sf), SR.datasets(spark, sf), 50)
    return h.select("model_id", "dataset_id", "model_name", "dataset_name", r6("eval_score"),
                    F.date_format("evaluated_at", TS).alias("evaluated_at"))


@register("registry_enrich", W("models", "datasets", "evaluations") + """
SELECT e.model_id, e.dataset_id, coalesce(m.name, 'Unknown Model') AS model_name,
       coalesce(d.name, 'Unknown Dataset') AS dataset_name
FROM evaluations e LEFT JOIN (SELECT * FROM models WHERE model_type = 'classification') m USING (model_id)
LEFT JOIN datasets d USING (dataset_id)""")
def q_enrich(spark, sf):
    m = SR.models(spark, sf).filter(F.col("model_type") == "classification")
    return RG.enrich(SR.evaluations(spark, sf), m, SR.datasets(spark, sf)).select(
        "model_id", "dataset_id", "model_name", "dataset_name")


@register("registry_best_evaluation", W("models", "evaluations") + """,
req AS (SELECT model_id, 'Brand#11' AS dataset_id FROM models),
j AS (SELECT r.model_id, r.dataset_id, e.dataset_id AS eval_dataset_id, e.eval_score, e.evaluated_at
      FROM req r JOIN evaluations e ON r.model_id = e.model_id)
SELECT model_id, dataset_id, eval_dataset_id, """ + O.rh("eval_score") + """ AS eval_score,
       eval_dataset_id = dataset_id AS exact_match
FROM (SELECT *, row_number() OVER (PARTITION BY model_id, dataset_id
        ORDER BY (eval_dataset_id = dataset_id) DESC, evaluated_at DESC, eval_dataset_id) AS rn FROM j)
WHERE rn = 1""")
def q_best_eval(spark, sf):
    req = SR.models(spark, sf).select("model_id", F.lit("Brand#11").alias("dataset_id"))
    b = RG.best_evaluation(req, SR.evaluations(spark, sf))
    return b.select("model_id", "dataset_id", "eval_dataset_id", r6("eval_score"), "exact_match")


@register("registry_missing_evaluations", W("models", "evaluations") + """
SELECT m.model_id, d.dataset_id FROM models m, (VALUES ('Brand#11'), ('Brand#23'), ('Brand#99')) d(dataset_id)
WHERE NOT EXISTS (SELECT 1 FROM evaluations e WHERE e.model_id = m.model_id AND e.dataset_id = d.dataset_id)""")
def q_missing(spark, sf):
    return RG.missing_evaluations(SR.models(spark, sf), ["Brand#11", "Brand#23", "Brand#99"],
                                  SR.evaluations(spark, sf)).select("model_id", "dataset_id")


@register("registry_pair_list", W("models", "datasets", "evaluations") + """,
pairs AS (SELECT DISTINCT l_suppkey AS model_id, p_brand AS dataset_id FROM lineitem JOIN part ON l_partkey = p_partkey
          WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 49)
SELECT p.model_id, p.dataset_id, m.name AS model_name, d.name AS dataset_name, """ + O.rh("e.eval_score") + """ AS eval_score
FROM pairs p JOIN models m USING (model_id) JOIN datasets d USING (dataset_id) JOIN evaluations e USING (model_id, dataset_id)""")
def q_pair_list(spark, sf):
    li = table(spark, sf, "lineitem")
    pt = table(spark, sf, "part")
    pairs = (li.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 49))
               .join(pt, li.l_partkey == pt.p_partkey)
               .select(F.col("l_suppkey").alias("model_id"), F.col("p_brand").alias("dataset_id")).distinct())
    m = SR.models(spark, sf).select("model_id", F.col("name").alias("model_name"))
    d = SR.datasets(spark, sf).select("dataset_id", F.col("name").alias("dataset_name"))
    e = SR.evaluations(spark, sf).select("model_id", "dataset_id", "eval_score")
    return pairs.join(m, "model_id").join(d, "dataset_id").join(e, ["model_id", "dataset_id"]).select(
        "model_id", "dataset_id", "model_name", "dataset_name", r6("eval_score"))


@register("registry_version_ownership", W("models") + """,
versions AS (SELECT l_suppkey AS model_id, date_trunc('month', l_shipdate) AS created_at FROM lineitem GROUP BY ALL)
SELECT v.model_id, strftime(v.created_at, '""" + DTS + """') AS created_at FROM versions v
WHERE EXISTS (SELECT 1 FROM models m WHERE m.model_id = v.model_id AND m.user_id = 7)""")
def q_version_ownership(spark, sf):
    v = (table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model_id"),
                                             F.date_trunc("month", "l_shipdate").alias("created_at")).distinct())
    own = RG.owned_by(SR.models(spark, sf), 7).select("model_id")
    return v.join(own, "model_id", "left_semi").select("model_id", F.date_format("created_at", TS).alias("created_at"))


@register("registry_versions", W("models") + """,
v AS (SELECT l_suppkey AS model_id, date_trunc('month', l_shipdate) AS created_at,
             'models/v/' || CAST(l_suppkey AS VARCHAR) || '/' || strftime(date_trunc('month', l_shipdate), '%Y%m') || '.onnx' AS file_path
      FROM lineitem GROUP BY ALL),
vv AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at, file_path) AS version FROM v)
SELECT model_id, version, file_path, version = max(version) OVER (PARTITION BY model_id) AS is_production FROM vv""")
def q_versions(spark, sf):
    v = (table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.date_trunc("month", "l_shipdate").alias("created_at"))
        .distinct()
        .withColumn("file_path", F.concat(F.lit("models/v/"), F.col("model_id").cast("string"), F.lit("/"),
                                          F.date_format("created_at", "yyyyMM"), F.lit(".onnx"))))
    return RG.promote_latest(RG.versions_from(v)).select("model_id", "version", "file_path", "is_production")


_VERSIONS_SQL = """v AS (SELECT l_suppkey AS model_id, date_trunc('month', l_shipdate) AS created_at,
             'models/v/' || CAST(l_suppkey AS VARCHAR) || '/' || strftime(date_trunc('month', l_shipdate), '%Y%m') || '.onnx' AS file_path
      FROM lineitem GROUP BY ALL),
vv AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at, file_path) AS version FROM v)"""


def _versions(spark, sf):
    v = (table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.date_trunc("month", "l_shipdate").alias("created_at"))
        .distinct()
        .withColumn("file_path", F.concat(F.lit("models/v/"), F.col("model_id").cast("string"), F.lit("/"),
                                          F.date_format("created_at", "yyyyMM"), F.lit(".onnx"))))
    return RG.versions_from(v)


@register("registry_promote_requested", W("models") + ",\n" + _VERSIONS_SQL + """
SELECT m.model_id, m.name, CASE WHEN m.model_id % 2 = 0 THEN coalesce(p.version, 0) ELSE 0 END AS production_version,
       CASE WHEN m.model_id % 2 = 0 AND p.version IS NOT NULL THEN p.file_path ELSE m.file_path END AS file_path,
       count(*) FILTER (WHERE w.version = CASE WHEN m.model_id % 2 = 0 AND p.version IS NOT NULL THEN p.version ELSE w.latest END) AS in_production
FROM models m LEFT JOIN vv p ON p.model_id = m.model_id AND p.version = 2
LEFT JOIN (SELECT *, max(version) OVER (PARTITION BY model_id) AS latest FROM vv) w ON w.model_id = m.model_id GROUP BY ALL""")
def q_promote(spark, sf):
    """Version 2 is asked for of every second model; the model row follows."""
    m = SR.models(spark, sf)
    ask = m.filter("model_id % 2 = 0").select("model_id", F.lit(2).alias("version"))
    v, models = RG.promote(RG.promote_latest(_versions(spark, sf)), ask, m)
    n = v.groupBy("model_id").agg(F.count(F.when(F.col("is_production"), 1)).alias("in_production"))
    return (models.join(n, "model_id", "left").select("model_id", "name", F.coalesce("production_version", F.lit(0)).alias("production_version"), "file_path",
                                                      F.coalesce("in_production", F.lit(0)).alias("in_production")))


@register("registry_versions_page", W("models") + ",\n" + _VERSIONS_SQL + """
SELECT model_id, version, file_path, (SELECT count(*) FROM vv WHERE model_id = 3) AS total
FROM vv WHERE model_id = 3 ORDER BY version DESC LIMIT 10 OFFSET 5""")
def q_versions_page(spark, sf):
    """C4: a page of a model's versions, newest first, with their number."""
    v = _versions(spark, sf).filter("model_id = 3")
    total = v.agg(F.count(F.lit(1)).alias("total"))
    page = RG.paged(v, [F.col("version").desc()], 5, 10).withColumn("_k", F.lit(1))
    return page.join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").select("model_id", "version", "file_path", "total")


@register("registry_create_models", W("models") + """,
new AS (SELECT CAST(c_nationkey AS BIGINT) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || c_custkey ELSE c_name END AS name FROM customer GROUP BY ALL),
fresh AS (SELECT n.*, row_number() OVER (ORDER BY user_id, name) AS k FROM new n
          WHERE NOT EXISTS (SELECT 1 FROM models m WHERE m.user_id = n.user_id AND m.name = n.name))
SELECT model_id, user_id, name FROM models UNION ALL SELECT (SELECT max(model_id) FROM models) + k, user_id, name FROM fresh""")
def q_create_models(spark, sf):
    """Models registered in bulk; names that their user has are left out."""
    new = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.col("c_custkey"))).otherwise(F.col("c_name")).alias("name")).distinct()
    return RG.create_models(SR.models(spark, sf), new).select("model_id", "user_id", "name")


@register("registry_summary", W("models") + """,
v AS (SELECT l_suppkey AS model_id, count(DISTINCT date_trunc('month', l_shipdate)) AS n_versions FROM lineitem GROUP BY ALL)
SELECT m.user_id, CAST(sum(coalesce(v.n_versions, 0)) AS BIGINT) AS versions_total,
       count(v.model_id) AS models_in_production, count(*) AS models
FROM models m LEFT JOIN v USING (model_id) GROUP BY m.user_id""")
def q_registry_summary(spark, sf):
    v = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model_id"))
         .agg(F.count_distinct(F.date_trunc("month", "l_shipdate")).alias("n_versions")))
    m = SR.models(spark, sf).join(v, "model_id", "left")
    return m.groupBy("user_id").agg(F.sum(F.coalesce("n_versions", F.lit(0))).cast("long").alias("versions_total"),
                                    F.count("n_versions").alias("models_in_production"),
                                    F.count(F.lit(1)).alias("models"))


@register("registry_models_per_user", W("models") + """
SELECT user_id, count(*) AS n_models FROM models GROUP BY user_id""")
def q_models_per_user(spark, sf):
    return SR.models(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_models"))


@register("registry_dashboard_kpis", W("models", "evaluations") + f""",
ev AS (SELECT DISTINCT model_id FROM evaluations),
pm AS (SELECT m.user_id, count(*) AS total_models, count(ev.model_id) AS evaluated_models
       FROM models m LEFT JOIN ev USING (model_id) GROUP BY m.user_id),
pe AS (SELECT m.user_id, count(*) AS total_evaluations, round(avg(e.accuracy) * 100) AS avg_accuracy_pct,
              avg(e.eval_score) AS avg_eval,
              count(*) FILTER (WHERE e.evaluated_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS recent_evaluations
       FROM evaluations e JOIN models m USING (model_id) GROUP BY m.user_id)
SELECT pm.user_id, total_models, evaluated_models, total_models - evaluated_models AS unevaluated_models,
       coalesce(total_evaluations, 0) AS total_evaluations, avg_accuracy_pct,
       {O.rh('avg_eval', 1)} AS avg_eval_score, coalesce(recent_evaluations, 0) AS recent_evaluations
FROM pm LEFT JOIN pe USING (user_id)""")
def q_dashboard(spark, sf):
    k = RG.dashboard_kpis(SR.models(spark, sf), SR.evaluations(spark, sf), NOW)
    return k.select("user_id", "total_models", "evaluated_models", "unevaluated_models", "total_evaluations",
                    "avg_accuracy_pct", round_half(F.col("_avg_eval"), 1).alias("avg_eval_score"),
                    "recent_evaluations")


@register("registry_comparison_summary", W("evaluations") + """
SELECT dataset_id, count(*) AS n_models,
       arg_max(model_id, (coalesce(trust_score, eval_score), -model_id)) AS best_model,
       """ + O.rh("avg(coalesce(trust_score, 0.0::DOUBLE))") + """ AS avg_trust,
       count(*) FILTER (WHERE guard_triggered) AS n_guarded
FROM evaluations GROUP BY dataset_id""")
def q_comparison(spark, sf):
    c = RG.comparison_summary(SR.evaluations(spark, sf))
    return c.select("dataset_id", "n_models", "best_model", r6("avg_trust"), "n_guarded")


@register("registry_primary_metric", W("evaluations") + """
SELECT model_id, dataset_id, CASE WHEN accuracy IS NOT NULL THEN 'accuracy' ELSE 'eval_score' END AS primary_metric,
       """ + O.rh("coalesce(accuracy, eval_score)") + """ AS primary_value FROM evaluations""")
def q_primary_metric(spark, sf):
    p = RG.primary_metric(SR.evaluations(spark, sf))
    return p.select("model_id", "dataset_id", "primary_metric", r6("primary_value"))


@register("registry_has_fairness_latest", W("evaluations") + f"""
SELECT model_id, arg_max(dataset_id, (evaluated_at, dataset_id)) AS dataset_id,
       strftime(max(evaluated_at), '{DTS}') AS evaluated_at
FROM evaluations WHERE has_fairness GROUP BY model_id""")
def q_has_fairness(spark, sf):
    e = SR.evaluations(spark, sf).filter(F.col("has_fairness"))
    return e.groupBy("model_id").agg(
        F.max_by("dataset_id", F.struct("evaluated_at", "dataset_id")).alias("dataset_id"),
        F.date_format(F.max("evaluated_at"), TS).alias("evaluated_at"))


@register("registry_paged_models", W("models") + f"""
SELECT model_id, name, strftime(uploaded_at, '{DTS}') AS uploaded_at, (SELECT count(*) FROM models WHERE user_id = 3) AS total
FROM models WHERE user_id = 3 ORDER BY uploaded_at DESC, model_id LIMIT 2 OFFSET 1""")
def q_paged(spark, sf):
    m = RG.owned_by(SR.models(spark, sf), 3)
    total = m.agg(F.count(F.lit(1)).alias("total"))
    page = RG.paged(m, [F.col("uploaded_at").desc(), F.col("model_id")], 1, 2)
    # the total is a one-row aggregate: joined on a constant key, bounded
    return (page.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
                .select("model_id", "name", F.date_format("uploaded_at", TS).alias("uploaded_at"), "total"))


@register("registry_framework", W("models") + """
SELECT model_id, file_path,
       CASE WHEN regexp_extract(lower(file_path), '(\\.[a-z0-9]+)$', 1) IN ('.pkl', '.joblib', '.pt', '.pth', '.h5', '.onnx')
            THEN map_extract(MAP {'.pkl': 'sklearn', '.joblib': 'sklearn', '.pt': 'pytorch', '.pth': 'pytorch', '.h5': 'keras', '.onnx': 'onnx'},
                             regexp_extract(lower(file_path), '(\\.[a-z0-9]+)$', 1))[1] END AS framework
FROM models""")
def q_framework(spark, sf):
    m = SR.models(spark, sf)
    return m.select("model_id", "file_path", RG.framework_of(F.col("file_path")).alias("framework"))


@register("registry_search", W("models") + """
SELECT model_id, name, CASE WHEN lower(name) = 'supplier#000000011' OR lower(model_type) = 'supplier#000000011' THEN 0
                            WHEN starts_with(lower(name), 'supplier#000000011') OR starts_with(lower(model_type), 'supplier#000000011') THEN 1
                            ELSE 2 END AS relevance
FROM models WHERE (contains(lower(name), 'supplier#000000011') OR contains(lower(model_type), 'supplier#000000011'))
  AND model_type = 'classification'""")
def q_search(spark, sf):
    s = RG.text_search(SR.models(spark, sf), ["name", "model_type"], "Supplier#000000011",
                       {"model_type": "classification", "framework": "all"})
    return s.select("model_id", "name", "relevance")


@register("registry_cross_search", W("models", "datasets") + """,
m AS (SELECT 'model' AS entity, CAST(model_id AS VARCHAR) AS id, name,
             CASE WHEN lower(name) = 'brand#1' OR lower(model_type) = 'brand#1' THEN 0
                  WHEN starts_with(lower(name), 'brand#1') OR starts_with(lower(model_type), 'brand#1') THEN 1 ELSE 2 END AS relevance
      FROM models WHERE contains(lower(name), 'brand#1') OR contains(lower(model_type), 'brand#1')),
d AS (SELECT 'dataset' AS entity, dataset_id AS id, name,
             CASE WHEN lower(name) = 'brand#1' OR lower(file_path) = 'brand#1' THEN 0
                  WHEN starts_with(lower(name), 'brand#1') OR starts_with(lower(file_path), 'brand#1') THEN 1 ELSE 2 END AS relevance
      FROM datasets WHERE contains(lower(name), 'brand#1') OR contains(lower(file_path), 'brand#1')),
u AS (SELECT * FROM m UNION ALL SELECT * FROM d)
SELECT entity, id, name, relevance, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY relevance, name, id) AS rn FROM u) WHERE rn <= 5""")
def q_cross_search(spark, sf):
    return RG.cross_entity_search(SR.models(spark, sf), SR.datasets(spark, sf), "Brand#1", 5)


@register("registry_tags", W("models") + """
SELECT model_id, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS tags
FROM models""")
def q_tags(spark, sf):
    m = SR.models(spark, sf)
    return m.select("model_id", F.array_join(RG.parse_tags(F.col("tags")), ",").alias("tags"))


@register("cache_pair_id", W("models", "datasets", "evaluations") + """,
sig AS (SELECT e.model_id, e.dataset_id,
  concat_ws('|', coalesce(CAST(m.model_id AS VARCHAR), ''), coalesce(m.file_path, ''),
            CASE WHEN m.file_size IS NULL OR m.file_size = 0 THEN '' ELSE CAST(m.file_size AS VARCHAR) END,
            coalesce(strftime(m.uploaded_at, '%Y-%m-%dT%H:%M:%S'), '')) AS ms,
  concat_ws('|', coalesce(d.dataset_id, ''), coalesce(d.file_path, ''),
            CASE WHEN d.file_size IS NULL OR d.file_size = 0 THEN '' ELSE CAST(d.file_size AS VARCHAR) END,
            coalesce(strftime(d.uploaded_at, '%Y-%m-%dT%H:%M:%S'), '')) AS ds
  FROM evaluations e LEFT JOIN models m USING (model_id) LEFT JOIN datasets d USING (dataset_id))
SELECT model_id, dataset_id, sha256(ms || '||' || ds) AS pair_cache_id FROM sig""")
def q_cache_id(spark, sf):
    e = SR.evaluations(spark, sf).select("model_id", "dataset_id")
    return RG.pair_cache_id(SR.models(spark, sf), SR.datasets(spark, sf), e).select(
        "model_id", "dataset_id", "pair_cache_id")


@register("cache_freshness", W("models", "datasets", "evaluations") + """,
sig AS (SELECT e.model_id, e.dataset_id, e.has_fairness, e.evaluated_at, m.uploaded_at AS mu, d.uploaded_at AS du,
  sha256(concat_ws('|', coalesce(CAST(m.model_id AS VARCHAR), ''), coalesce(m.file_path, ''),
            CASE WHEN m.file_size IS NULL OR m.file_size = 0 THEN '' ELSE CAST(m.file_size AS VARCHAR) END,
            coalesce(strftime(m.uploaded_at, '%Y-%m-%dT%H:%M:%S'), '')) || '||' ||
         concat_ws('|', coalesce(d.dataset_id, ''), coalesce(d.file_path, ''),
            CASE WHEN d.file_size IS NULL OR d.file_size = 0 THEN '' ELSE CAST(d.file_size AS VARCHAR) END,
            coalesce(strftime(d.uploaded_at, '%Y-%m-%dT%H:%M:%S'), ''))) AS expected_id
  FROM evaluations e LEFT JOIN models m USING (model_id) LEFT JOIN datasets d USING (dataset_id))
SELECT model_id, dataset_id,
  CASE WHEN has_fairness THEN (CASE WHEN model_id % 2 = 0 THEN expected_id ELSE 'stale' END) = expected_id
       ELSE evaluated_at IS NOT NULL AND (mu IS NULL OR evaluated_at >= mu) AND (du IS NULL OR evaluated_at >= du) END AS is_fresh
FROM sig""")
def q_cache_fresh(spark, sf):
    e = SR.evaluations(spark, sf)
    exp = RG.pair_cache_id(SR.models(spark, sf), SR.datasets(spark, sf), e.select("model_id", "dataset_id"))
    stored = e.join(exp.select("model_id", "dataset_id", "pair_cache_id"), ["model_id", "dataset_id"]).select(
        "model_id", "dataset_id", "evaluated_at",
        F.when(F.col("has_fairness"), F.when(F.col("model_id") % 2 == 0, F.col("pair_cache_id"))
               .otherwise(F.lit("stale"))).alias("stored_pair_id"))
    return RG.cache_fresh(stored, exp)


@register("registry_dedupe", W("datasets") + f""",
dd AS (SELECT dataset_id, user_id, uploaded_at, sha256(CAST(user_id AS VARCHAR)) AS file_hash FROM datasets)
SELECT user_id, file_hash, arg_max(dataset_id, (uploaded_at, dataset_id)) AS dataset_id, count(*) AS copies
FROM dd GROUP BY user_id, file_hash""")
def q_dedupe(spark, sf):
    d = SR.datasets(spark, sf).withColumn("file_hash", F.sha2(F.col("user_id").cast("string"), 256))
    return RG.latest_duplicate(d).select("user_id", "file_hash", "dataset_id", "copies")


@register("registry_unique_names", W("datasets") + """,
up AS (SELECT DISTINCT CAST(p_size % 25 AS BIGINT) AS user_id, 'Brand#' || CAST(p_size AS VARCHAR) AS name FROM part)
SELECT up.user_id, up.name, CASE WHEN t.name IS NOT NULL THEN up.name || ' (20240102030405)' ELSE up.name END AS effective_name
FROM up LEFT JOIN (SELECT DISTINCT user_id, name FROM datasets) t ON up.user_id = t.user_id AND up.name = t.name""")
def q_unique_names(spark, sf):
    up = table(spark, sf, "part").select((F.col("p_size") % 25).cast("long").alias("user_id"),
                                         F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("name")).distinct()
    return RG.unique_names(up, SR.datasets(spark, sf), "2024-01-02 03:04:05").select("user_id", "name", "effective_name")


@register("registry_upsert", W("evaluations") + """,
newe AS (SELECT model_id, dataset_id, eval_score + 1 AS eval_score FROM evaluations WHERE accuracy > 0.5)
SELECT model_id, dataset_id, """ + O.rh("eval_score") + """ AS eval_score FROM (
  SELECT model_id, dataset_id, eval_score FROM evaluations e
  WHERE NOT EXISTS (SELECT 1 FROM newe n WHERE n.model_id = e.model_id AND n.dataset_id = e.dataset_id)
  UNION ALL SELECT * FROM newe)""")
def q_upsert(spark, sf):
    e = SR.evaluations(spark, sf)
    new = e.filter(F.col("accuracy") > 0.5).select("model_id", "dataset_id", (F.col("eval_score") + 1).alias("eval_score"))
    return RG.upsert(e.select("model_id", "dataset_id", "eval_score"), new, ["model_id", "dataset_id"]).select(
        "model_id", "dataset_id", r6("eval_score"))


@register("registry_mark_evaluated", W("models", "evaluations") + """
SELECT m.model_id, EXISTS (SELECT 1 FROM evaluations e WHERE e.model_id = m.model_id AND e.eval_score > 70) AS is_evaluated
FROM models m""")
def q_mark(spark, sf):
    e = SR.evaluations(spark, sf).filter(F.col("eval_score") > 70)
    return RG.mark_evaluated(SR.models(spark, sf), e).select("model_id", "is_evaluated")


@register("registry_delete_cascade", W("evaluations") + """
SELECT model_id, dataset_id FROM evaluations WHERE dataset_id NOT IN ('Brand#11', 'Brand#12')""")
def q_delete(spark, sf):
    spark_ = spark
    deleted = spark_.createDataFrame([("Brand#11",), ("Brand#12",)], "dataset_id string")
    _, evals = RG.delete_cascade(SR.datasets(spark, sf), deleted, [SR.evaluations(spark, sf)], "dataset_id")
    return evals.select("model_id", "dataset_id")


@register("job_latest_status", """
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status,
       arg_max(value, (ts, event_id)) AS progress, count(*) AS n_updates
FROM events GROUP BY user_id""")
def q_latest_status(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"),
                                           F.col("value").alias("progress"), "ts", "event_id")
    return RG.latest_status(ev)


@register("job_listing", f"""
SELECT event_id AS job_id, user_id, event_type AS status, value AS progress, strftime(ts, '{DTS}') AS created_at
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20""")
def q_job_listing(spark, sf):
    ev = table(spark, sf, "events")
    return (ev.filter(F.col("event_type") == "error").orderBy(F.col("ts").desc(), "event_id").limit(20)
              .select(F.col("event_id").alias("job_id"), "user_id", F.col("event_type").alias("status"),
                      F.col("value").alias("progress"), F.date_format("ts", TS).alias("created_at")))


@register("rate_limit_window", """
SELECT user_id, event_id, n_in_window, n_in_window > 60 AS over_limit, greatest(0, 60 - n_in_window) AS remaining FROM (
  SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
         RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW) AS n_in_window FROM events)""")
def q_rate(spark, sf):
    return rate_window(table(spark, sf, "events"))


@register("dataset_preview", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {O.rh('o_totalprice', 2)} AS o_totalprice,
       strftime(o_orderdate, '{DTS}') AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 10""")
def q_preview(spark, sf):
    o = table(spark, sf, "orders").orderBy("o_orderkey").limit(10)
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", r6("o_totalprice", 2),
                    F.date_format("o_orderdate", TS).alias("o_orderdate"), "o_orderpriority")


@register("dataset_preview_stats", """
WITH h AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10), n AS (SELECT count(*) AS total_rows FROM orders)
SELECT ord, col AS "column", dtype, nulls::BIGINT AS preview_nulls, total_rows, 6 AS total_columns FROM n, (
""" + "\nUNION ALL\n".join(
    f"SELECT {i} AS ord, '{c}' AS col, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM h"
    for i, (c, t) in enumerate([("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")])) + ")")
def q_preview_stats(spark, sf):
    """Types, preview nulls and totals of the previewed table."""
    from trustframe.operators.io import preview
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                          F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority")
    return preview(o, ["o_orderkey"])[1]


def _cell(c: str) -> str:
    return f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


@register("dataset_fingerprint", f"""
WITH h AS (SELECT *, ('0x' || substr(md5({" || '|' || ".join(_cell(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))}), 1, 15))::BIGINT AS h FROM customer)
SELECT count(*) AS row_count, 5 AS col_count, 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS columns,
       'c_acctbal:double,c_custkey:bigint,c_mktsegment:string,c_name:string,c_nationkey:int' AS dtypes,
       CAST(count(*) FILTER (WHERE c_custkey IS NULL) + count(*) FILTER (WHERE c_name IS NULL)
            + count(*) FILTER (WHERE c_nationkey IS NULL) + count(*) FILTER (WHERE c_acctbal IS NULL)
            + count(*) FILTER (WHERE c_mktsegment IS NULL) AS BIGINT) AS null_count,
       sum(h)::VARCHAR AS checksum, bit_xor(h) AS checksum_xor
FROM h""")
def q_fingerprint(spark, sf):
    from trustframe.operators.io import fingerprint
    return fingerprint(table(spark, sf, "customer"))


@register("registry_get_model", W("models") + """
SELECT model_id, name, model_type FROM models WHERE user_id = 7 AND model_id IN (SELECT min(model_id) FROM models WHERE user_id = 7)""")
def q_get_model(spark, sf):
    """C7 + F1: fetch one model by id for its owner (the owner's first model)."""
    m = SR.models(spark, sf)
    first = RG.owned_by(m, 7).agg(F.min("model_id").alias("model_id"))
    return RG.owned_by(m, 7).join(first, "model_id", "left_semi").select("model_id", "name", "model_type")


@register("registry_dataset_path", W("datasets") + """
SELECT file_path FROM datasets WHERE user_id = 11 AND dataset_id = 'Brand#11'""")
def q_dataset_path(spark, sf):
    """Registry lookup by (id, owner) before the read."""
    return RG.dataset_path_for_owner(SR.datasets(spark, sf), "Brand#11", 11)


@register("registry_datasets_read", f"""
WITH csv AS (SELECT p_brand AS dataset_id, p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS note,
                    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part),
par AS (SELECT n_name AS dataset_id, s_suppkey, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (
SELECT dataset_id, count(*) AS row_count, 4 AS col_count, 'p_retailprice' AS target, 'p_partkey,note,p_size' AS features,
       CAST(count(*) * 4 - count(p_partkey) - count(note) - count(p_size) - count(p_retailprice) AS BIGINT) AS null_count,
       sum(p_retailprice) AS target_total FROM csv GROUP BY 1
UNION ALL
SELECT dataset_id, count(*), 3, 's_acctbal', 's_suppkey,s_name', CAST(count(*) * 3 - count(s_suppkey) - count(s_name) - count(s_acctbal) AS BIGINT),
       sum(s_acctbal) FROM par GROUP BY 1)
SELECT dataset_id, row_count, col_count, target, features, null_count, {O.rh('target_total', 2)} AS target_total FROM p""")
def q_datasets_read(spark, sf):
    """The parts of each brand exported as CSV (with missing-value tokens), the suppliers of each
    nation as Parquet, all registered; then read back through the registry, with roles and profile."""
    part = table(spark, sf, "part").select(
        F.col("p_brand").alias("id"), "p_partkey", F.when(F.col("p_size") % 7 == 0, "N/A").otherwise(F.col("p_type")).alias("note"),
        F.when(F.col("p_size") % 5 == 0, "nan").otherwise(F.col("p_size").cast("string")).alias("p_size"), "p_retailprice")
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("id"))
    supplier = (table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .select("id", "s_suppkey", "s_name", "s_acctbal"))
    registry = RD.export_datasets(part, "id", F.substring("id", 7, 3), "csv").unionByName(
        RD.export_datasets(supplier, "id", F.lit(0), "parquet"))
    out = None
    for columns, data in RD.read_registered(spark, registry):
        p = RD.profile(columns, data)
        out = p if out is None else out.unionByName(p)
    return out.withColumn("target_total", round_half(F.col("target_total"), 2))


@register("registry_versions_refresh", W("models") + ",\n" + _VERSIONS_SQL + """,
sz AS (SELECT l_suppkey AS model_id, date_trunc('month', l_shipdate) AS created_at, CAST(sum(l_orderkey) AS BIGINT) AS file_size FROM lineitem GROUP BY ALL),
last AS (SELECT model_id, arg_max(vv.file_path, version) AS path, arg_max(sz.file_size, version) AS size, count(*) AS n
         FROM vv JOIN sz USING (model_id, created_at) GROUP BY model_id)
SELECT m.model_id, coalesce(path, m.file_path) AS file_path, coalesce(size, m.file_size) AS file_size, coalesce(n, 0) AS n_versions
FROM models m LEFT JOIN last USING (model_id)""")
def q_refresh(spark, sf):
    """Models with the path and size of their newest version."""
    month = F.date_trunc("month", "l_shipdate").alias("created_at")
    size = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model_id"), month).agg(F.sum("l_orderkey").cast("long").alias("file_size"))
    v = _versions(spark, sf).join(size, ["model_id", "created_at"])
    return RG.refresh_models(SR.models(spark, sf), v).select("model_id", "file_path", "file_size", "n_versions")


@register("registry_upload_check", W("models") + """,
d AS (SELECT model_id, regexp_extract(lower(file_path), '(\\.[a-z0-9]+)$', 1) AS ext,
             CASE WHEN model_id % 3 = 0 THEN NULL WHEN model_id % 3 = 1 THEN 'sklearn' ELSE 'ONNX ' END AS declared FROM models),
f AS (SELECT *, CASE ext WHEN '.pkl' THEN 'sklearn' WHEN '.joblib' THEN 'sklearn' WHEN '.pt' THEN 'pytorch' WHEN '.pth' THEN 'pytorch'
                         WHEN '.h5' THEN 'keras' WHEN '.onnx' THEN 'onnx' END AS framework FROM d)
SELECT model_id, CASE WHEN framework IS NULL THEN 'extension_not_allowed' WHEN lower(trim(declared)) <> framework THEN 'framework_mismatch'
                      ELSE 'accepted' END AS verdict FROM f""")
def q_upload_check(spark, sf):
    """uploads whose extension isn't allowed, or isn't of the framework that they declare."""
    declared = F.when(F.col("model_id") % 3 == 1, "sklearn").when(F.col("model_id") % 3 == 2, "ONNX ")
    return SR.models(spark, sf).select("model_id", RG.framework_check(F.col("file_path"), declared).alias("verdict"))
