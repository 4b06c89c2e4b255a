"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is forced end to end with the ``noop`` sink (full execution, no
collect to the driver).  Before timing, every headline query runs once on
the sf0.001 tables (not timed), so JVM JIT and Spark code generation are warm,
as on a long-running cluster; the timed runs then read $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trustframe.plans.catalog import QUERIES, load_all  # noqa: E402
from trustframe.session import get_spark  # noqa: E402

HEADLINE = [
    "evaluation_orders_status",
    "evaluation_lineitem_price",
    "evaluation_docs_quality",
    "metrics_multiclass",
    "metrics_regression",
    "fairness_gaps",
    "fairness_regression",
    "health_stats_lineitem",
    "insights_quality_lineitem",
    "insights_outliers_iqr_lineitem",
    "insights_pearson_matrix_lineitem",
    "insights_spearman_matrix_lineitem",
]
OPTIONAL = ["evaluation_orders_multiclass", "insights_quality_documents", "insights_outliers_iqr_documents",
            "leaderboard", "registry_history", "rate_limit_window", "text_bleu_corpus",
            "text_rouge_12", "sweep_lambda_sensitivity", "attribution_linear_global",
            "experiment_fold_summary", "cache_pair_id"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("trustframe-bench", cpus=cpus, shuffle_partitions=int(cpus) * 2,
                      extra={"spark.sql.codegen.cache.maxEntries": "2000"})
    load_all()
    names = [n for n in HEADLINE if n in QUERIES] + [n for n in OPTIONAL if n in QUERIES]
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:  # warm-up on the smallest tables, not timed
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
