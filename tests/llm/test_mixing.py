import hashlib
import math

import pytest

from trustframe.llm.mixing import PoissonMix


def draws(doc_id, rate, seed=17, part=8.0):
    parts, n = math.ceil(rate / part), 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 61:
            k += 1
            p *= rate / parts / k
            c += p
            n += 1
    return n


def test_counts_and_shares(spark, docs_of):
    rows = [(i, "x" * (10 + i % 50), "en", "abc"[i % 3 if i % 10 else 0]) for i in range(3000)]
    mix = PoissonMix(weights={"a": 1, "b": 2, "c": 5, "missing": 9})
    df = docs_of(rows)
    rate = {r["source"]: r["rate"] for r in mix.rates(df).collect()}
    size = {s: sum(len(t) for _, t, _, x in rows if x == s) for s in "abc"}
    for s, w in (("a", 1), ("b", 2), ("c", 5)):
        assert rate[s] == pytest.approx(w / 8 * sum(size.values()) / size[s])
    got = mix.mix(df, report=True).toPandas()
    want = {d: draws(d, rate[s]) for d, _, _, s in rows}
    assert got.groupby("doc_id").size().to_dict() == {d: n for d, n in want.items() if n}
    assert (got.groupby("doc_id")["copy"].max() == got.groupby("doc_id").size()).all()
    share = got.assign(b=got["text"].str.len()).groupby("source")["b"].sum() / sum(size.values())
    assert share["c"] == pytest.approx(5 / 8, rel=0.1)
    assert got["shuffle_key"].is_monotonic_increasing  # the whole output is in shuffled order
    assert abs(got["doc_id"].corr(got.index.to_series())) < 0.1


def test_large_rate_is_one_poisson(spark, docs_of):
    rows = [(i, "x", "en", "rare") for i in range(400)] + [(1000 + i, "y" * 100, "en", "rest") for i in range(400)]
    mix = PoissonMix(weights={"rare": 1, "rest": 1})
    rate = {r["source"]: r["rate"] for r in mix.rates(docs_of(rows)).collect()}
    n = mix.mix(docs_of(rows)).filter("source = 'rare'").groupBy("doc_id").count().toPandas()["count"]
    assert rate["rare"] > 50 and n.mean() == pytest.approx(rate["rare"], rel=0.05) and n.var() == pytest.approx(rate["rare"], rel=0.3)
    assert n.tolist() and set(n) >= {draws(0, rate["rare"])}


def test_nulls_clashes_and_empty(spark, docs_of):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", None), (2, "text", "en", "s"), (3, "t" * 50000, "en", "s"), (4, "no weight", "en", "z")]
    df = docs_of(rows).selectExpr("*", "5 AS rate", "6 AS copy", "7 AS N_COPIES", "8 AS cdf", "9 AS parts", "1 AS source_key", "2 AS shuffle_key", "3 AS u")
    out = PoissonMix(weights={None: 1.0, "s": 1.0}, budget=200000).mix(df)
    assert out.columns == df.columns
    got = out.toPandas()
    assert "z" not in set(got["source"].dropna())
    n = got["doc_id"].isna().sum()
    assert n > 0 and (got["doc_id"] == 1).sum() % 2 == 0  # repeated rows draw the same
    assert PoissonMix().mix(df).columns == df.columns
    assert PoissonMix().mix(df.limit(0)).count() == 0
    plan = PoissonMix().mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
