import numpy as np
from pyspark.sql import types as T

from trustframe.llm.common import ORACLE, QUERIES
from trustframe.llm.negatives import HardNegatives, Walk, kth, spanning_tree

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, every=100):
    ok = {}
    for i, v, label in sorted(((i, v, x) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)),
                              key=lambda r: (r[0], r[2], r[1])):
        ok.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in (i for i in ok if i % every == 0):
        score = {i: dot(ok[a][1], z) for i, (_, z) in ok.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if ok[i][0] == ok[a][0]][:5]:
            hard = [i for i in best if ok[i][0] != ok[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out |= {(a, p, r, n, score[p], score[n]) for r, n in enumerate(hard, 1)}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS) if isinstance(rows, list) else rows
    op = HardNegatives(**options)
    got = [tuple(r) for r in op.mine(op.rows(df)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, dim=8, seed=1, clusters=6):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(clusters, dim))
    out = []
    for i in range(n):
        v = heads[rng.integers(clusters)] + rng.normal(size=dim) * 0.3
        out.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], int(rng.integers(3))))
    return out


def test_matches_brute_force_in_small_blocks_and_chunks(spark):
    rows = vectors(700)
    want = brute(rows, 10)
    assert len(want) > 500
    assert mined(spark, rows, every=10) == want
    assert mined(spark, rows, every=10, block=8, chunk=100, slice=16) == want


def test_ties_one_vector_in_many_rows(spark):
    rows = vectors(300, dim=4) + [(1000 + i, [0.5, -0.5, 0.5, 0.5], i % 4) for i in range(400)]
    assert mined(spark, rows, block=4, chunk=64, slice=32) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = vectors(210, dim=3) + [(None, [1.0, 0.0, 0.0], 1), (500, None, 1), (600, [1.0, None, 0.0], 2), (700, [1.0, float("nan"), 0.0], 2),
                                  (800, [float("inf"), 0.0, 0.0], 2), (900, [0.5, 0.5, 0.5], None), (1000, [], 1), (1100, [1.0], 2), (300, [0.0, 0.0, 0.0], 1)]
    rows += rows[:30] + [(5, [9.0, 9.0, 9.0], 9)]  # repeated rows, and another vector under a known id
    assert mined(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(vectors(220), ROWS).selectExpr("*", "1 AS z", "2 AS chunk", "3 AS KIND", "'x' AS pos")
    assert mined(spark, df.limit(0)) == set()
    assert mined(spark, df) == brute(vectors(220))


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    nodes = np.floor(256 * (rng.normal(size=16) + rng.normal(size=(200, 16)) * 0.02))
    z = np.floor(256 * rng.normal(size=(500, 16)))
    order, parent, edge = spanning_tree(nodes)
    assert sorted(order) == list(range(200))
    walk = Walk(z, np.sqrt((z * z).sum(1)), nodes)
    for j, node in enumerate(order.tolist()):
        walk.enter(node, int(parent[node]), float(edge[node]), j == 0)
        exact = z @ nodes[node]
        assert (walk.lo[node] <= exact).all() and (exact <= walk.hi[node]).all()
        rows = np.flatnonzero(walk.hi[node] >= kth(walk.lo[node], 5))
        assert set(np.argsort(-exact)[:5]) <= set(rows)
        walk.rescore(node, rows)
    assert walk.scored < 0.5 * nodes.shape[0] * len(z)


def test_query_has_sql():
    assert "op13_hard_negatives" in QUERIES and "op13_hard_negatives" in ORACLE
