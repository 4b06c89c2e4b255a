"""Radix quartiles, cross products and Spearman over null patterns against pandas; guarded JSON."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustframe.functions.json import json_kind, json_number, json_text
from trustframe.operators import insights as IN


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 1500
    a = pd.DataFrame({"a": rng.normal(size=n) * 1e6, "b": rng.integers(-3, 4, n).astype(float), "c": rng.normal(size=n), "d": np.exp(rng.normal(size=n) * 8), "e": np.full(n, 2.5)})
    a["f"] = a["a"] * 2 + a["c"] * 1e5
    a["b"] = a["b"] * 0.0 + np.where(a["b"] > 0, a["b"], -0.0)  # a third of the rows share a value; -0.0 among them
    for c, p in (("c", 0.2), ("d", 0.1)):
        a.loc[rng.random(n) < p, c] = np.nan
    a["f"] = a["f"].where(a["c"].notna())  # the same nulls as c
    a["g"] = np.nan
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in a.itertuples(index=False)]
    return a, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in a.columns))


def test_quartiles_are_exact(frame):
    a, df = frame
    for rows in (a, a.head(3), a.head(1)):
        got = {r["column"]: (r["n"], r["q1"], r["q3"]) for r in IN.quartiles(df.limit(len(rows)) if len(rows) < len(a) else df, list(a.columns)).collect()}
        want = rows if len(rows) == len(a) else None
        if want is not None:
            for c in a.columns:
                if rows[c].notna().any():
                    assert got[c][0] == rows[c].notna().sum()
                    assert got[c][1:] == pytest.approx((rows[c].quantile(0.25), rows[c].quantile(0.75)), rel=1e-12, abs=1e-12)
            assert "g" not in got
    assert IN.quartiles(df.limit(0), list(a.columns)).count() == 0


def test_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 2.0**53, 2.0**53 + 2, np.inf])
    k = IN._keys(x)
    assert (np.diff(k.astype(object)) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == 10
    assert [IN._value(int(v)) for v in k] == x.tolist()


def pairs(got):
    return {(r["feature1"], r["feature2"]): r["correlation"] for r in got.collect()}


@pytest.mark.parametrize("sent", [1 << 20, 10, 0])
def test_correlations_with_nulls(frame, monkeypatch, sent):
    a, df = frame
    monkeypatch.setattr(IN, "SENT", sent)  # 10: the columns with many values are joined; 0: all
    for kind, got in (("pearson", IN.pearson_pairs(df, 0.0)), ("spearman", IN.spearman_pairs(df, 0.0))):
        want = a.corr(kind)
        got = pairs(got)
        for i, x in enumerate(a.columns):
            for y in a.columns[i + 1:]:
                if pd.isna(want.loc[x, y]):
                    assert (x, y) not in got
                else:
                    assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-4)


def test_null_patterns(frame):
    a, df = frame
    assert sorted(sorted(a.columns[i] for i in g) for g in IN._null_patterns(df, list(a.columns))) == [["a", "b", "e"], ["c", "f"], ["d"], ["g"]]


def test_many_columns_are_planned_without_an_expression_a_pair(spark):
    df = spark.range(50).select(*[(F.hash(F.col("id"), F.lit(i)) % 100).cast("double").alias(f"c{i}") for i in range(120)])
    got = IN.pearson_pairs(df, 0.0)
    assert got.count() == 120 * 119 // 2


def test_guarded_json(spark):
    docs = ['{"a": {"b": "x"}}', '{"a": {"b": 5}}', '{"a": "b"}', '[{"a": {"b": "x"}}]', '{"a": {"b": null}}', '{"a": {"b": ', "", None, "3", '{"a": {"b": ["x"]}}', '{"a": {"b": 1.5}}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    got = df.select(json_text(F.col("d"), "a", "b"), json_number(F.col("d"), "a", "b"), json_kind(F.col("d"))).collect()
    assert [r[0] for r in got] == ["x"] + [None] * 10
    assert [r[1] for r in got] == [None, 5.0] + [None] * 8 + [1.5]
    assert [r[2] for r in got] == ["object"] * 3 + ["array", "object", None, None, None, "scalar", "object", "object"]


def test_summary_finds_each_tables_fences_once(spark, monkeypatch):
    from trustframe.operators import insights
    from trustframe.plans.catalog import QUERIES, load_all
    load_all()
    calls, real = [], insights.column_quartiles
    monkeypatch.setattr(insights, "column_quartiles", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert QUERIES["insights_summary"](spark, "/root/testdata/sf0.001").count() == 5 and len(calls) == 5
