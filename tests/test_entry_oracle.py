"""Driver contract and a Spark-vs-DuckDB check of a sample of queries (sf0.001)."""
import duckdb
import pytest

import __spark_entry__ as entry_mod
from tools.compare import canon
from trustframe.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["evaluation_orders_status", "metrics_multiclass", "fairness_gaps", "health_stats_customer",
          "insights_quality_events", "leaderboard", "rate_limit_window", "text_rouge_12",
          "sweep_lambda_sensitivity", "cache_pair_id"]


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 6
    assert {"trust_score", "eval_score", "verdict_status"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    s = entry_mod.queries()[name](spark, SF).toPandas()
    o = con.execute(entry_mod.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert canon(s) == canon(o)
