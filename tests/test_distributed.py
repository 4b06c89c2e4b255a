"""Distributed operators against brute force on small inputs."""
import collections
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from trustframe.operators.events import rate_window
from trustframe.operators.splits import positional_split, with_position, with_running_sum
from trustframe.operators.text import corpus_bleu, rouge_l, rouge_n
from trustframe.sources import workloads as W
from trustframe.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_positions_with_hot_key(spark):
    """One key holds most rows; positions are exact and stable."""
    random.seed(3)
    rows = [("hot" if random.random() < 0.7 else f"k{random.randint(0, 9)}", i, random.random())
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, rid long, v double")
    got = {r.rid: (r.pos, r.group_n) for r in with_position(df, ["k"], ["v", "rid"], num_partitions=7).collect()}
    by = collections.defaultdict(list)
    for k, rid, v in rows:
        by[k].append((v, rid))
    for k, lst in by.items():
        for i, (_, rid) in enumerate(sorted(lst)):
            assert got[rid] == (i, len(lst))


def test_running_sum(spark):
    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, w long")
    got = {(r.k, r.t): r.running for r in with_running_sum(df, ["k"], ["t"], "w", num_partitions=5).collect()}
    acc = collections.Counter()
    for k, t, w in sorted(rows, key=lambda x: (x[0], x[1])):
        acc[k] += w
        assert got[(k, t)] == acc[k]


def test_positional_split_counts(spark):
    ds = W.orders_dataset(spark, SF)
    s = positional_split(ds, [], ["row_id"])
    n = ds.count()
    tr = s.filter(F.col("split") == "train")
    assert tr.count() == math.floor(0.8 * n)
    assert tr.agg(F.max("row_id")).first()[0] < s.filter(F.col("split") == "test").agg(F.min("row_id")).first()[0]


def test_rate_window_brute_force(spark):
    ev = table(spark, SF, "events").select("event_id", "user_id", "ts")
    rows = ev.collect()
    got = {r.event_id: r.n_in_window for r in rate_window(ev).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.user_id].append(r.ts)
    for r in rows:
        lo = r.ts - dt.timedelta(seconds=60)
        want = sum(1 for t in by[r.user_id] if lo < t <= r.ts)
        assert got[r.event_id] == want


def _grams(toks, n):
    return collections.Counter(" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1))


def test_text_metrics_brute_force(spark):
    import regex
    pairs = W.text_pairs(spark, SF).collect()
    bt = (lambda s: [t for t in regex.split(r"\s+", regex.sub(r"([^\p{L}\p{N}\s_])", r" \1 ", s).strip()) if t])
    rt = (lambda s: [t for t in regex.sub(r"[^a-z0-9]+", " ", s.lower()).split(" ") if t])
    m = [0] * 5
    t = [0] * 5
    c = r = 0
    f1s, f2s, fls = [], [], []
    for p in pairs:
        ptk, rtk = bt(p.prediction), bt(p.reference)
        c += len(ptk)
        r += len(rtk)
        for n in range(1, 5):
            gp, gr = _grams(ptk, n), _grams(rtk, n)
            m[n] += sum(min(v, gr[g]) for g, v in gp.items())
            t[n] += max(len(ptk) - n + 1, 0)
        pr, rr = rt(p.prediction), rt(p.reference)
        for n, acc in ((1, f1s), (2, f2s)):
            gp, gr = _grams(pr, n), _grams(rr, n)
            ov = sum(min(v, gr[g]) for g, v in gp.items())
            pp = ov / max(len(pr) - n + 1, 1) if len(pr) - n + 1 > 0 else 0.0
            rc = ov / max(len(rr) - n + 1, 1) if len(rr) - n + 1 > 0 else 0.0
            acc.append(2 * pp * rc / (pp + rc) if pp + rc > 0 else 0.0)
        # LCS
        dp = [[0] * (len(rr) + 1) for _ in range(len(pr) + 1)]
        for i in range(len(pr)):
            for j in range(len(rr)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if pr[i] == rr[j] else max(dp[i][j + 1], dp[i + 1][j])
        lcs = dp[-1][-1]
        pp = lcs / len(pr) if pr else 0.0
        rc = lcs / len(rr) if rr else 0.0
        fls.append(2 * pp * rc / (pp + rc) if pp + rc > 0 else 0.0)
    bp = 1.0 if c >= r else math.exp(1 - r / c)
    bleu = 100 * bp * math.exp(sum(math.log(m[n] / t[n]) for n in range(1, 5)) / 4) if min(m[1:]) > 0 else 0.0
    df = W.text_pairs(spark, SF)
    assert corpus_bleu(df, ["conv_id", "turn"]).first().bleu_score == pytest.approx(bleu, rel=1e-9)
    rn = rouge_n(df, ["conv_id", "turn"]).first()
    assert rn.rouge1 == pytest.approx(sum(f1s) / len(f1s), rel=1e-9)
    assert rn.rouge2 == pytest.approx(sum(f2s) / len(f2s), rel=1e-9)
    assert rouge_l(df, ["conv_id", "turn"]).first().rougeL == pytest.approx(sum(fls) / len(fls), rel=1e-9)


def test_order_statistics_exact_with_ties(spark):
    from trustframe.operators.splits import order_statistics
    random.seed(11)
    rows = [("hot" if random.random() < 0.6 else f"g{random.randint(0, 3)}",
             float(random.choice([random.random(), 5.0, 7.0]))) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = [("a", 0.25, "floor"), ("b", 0.75, "ceil"), ("c", 0.8, "floor_n")]
    got = {r.g: (r.a, r.b, r.c) for r in order_statistics(df, ["g"], "v", ranks, accuracy=50).collect()}
    by = collections.defaultdict(list)
    for g, v in rows:
        by[g].append(v)
    for g, vs in by.items():
        vs.sort()
        n = len(vs)
        assert got[g] == (vs[math.floor(0.25 * (n - 1))], vs[math.ceil(0.75 * (n - 1))], vs[math.floor(0.8 * n)])
    one = order_statistics(df, [], "v", [("m", 0.5, "floor")]).first()
    allv = sorted(v for _, v in rows)
    assert one.n == len(allv) and one.m == allv[math.floor(0.5 * (len(allv) - 1))]
