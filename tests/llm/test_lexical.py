import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import sample
from trustframe.llm.common import ORACLE, QUERIES
from trustframe.llm.lexical import LexicalSearch, Shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    each = [(d, Counter(t), len(t)) for d, x in docs if (t := terms(x))]
    n, total = len(each), sum(c for _, _, c in each)
    df = Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in items:
        score = []
        for d, c, size in each:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                score.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(score, key=lambda x: (x[0], x[1] is None, x[1]))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in LexicalSearch(**options).search(docs, items).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]


def test_matches_brute_force(spark, docs_of, items):
    docs = sample(spark)
    want = brute([r[:2] for r in docs], items)
    assert len(want) >= 10 * len(items) - 10
    assert found(spark, docs_of(docs), items) == want


def test_small_shards_blocks_groups_and_sets(spark, docs_of, items):
    docs = sample(spark)
    want = brute([r[:2] for r in docs], items)
    assert found(spark, docs_of(docs), items, shard=7, block=3, group=50) == want
    assert found(spark, docs_of(docs), items, postings=400, set_bytes=1500) == want


EDGE = [None, "", " .,-\x00 ", "a", "A", "É é", "a" * 5000, "x y z " * 3000, "word\n" * 2000, "a b c", "a b c", "a-b_c", "ß1 2 3", "名 名 字"]


def test_nulls_empty_long_ties_and_repeats(spark, docs_of):
    docs = [(i, t) for i, t in enumerate(EDGE)] + [(3, "a"), (None, "a b c"), (None, "a"), (50, "a b c")]
    items = [(1, "a"), (2, "a b c"), (3, None), (4, ""), (5, "名 É x x x"), (6, "nowhere"), (7, "a" * 5000), (2, "c c c"), (None, "word")]
    assert found(spark, docs_of(docs), items) == brute(docs, items)
    assert found(spark, docs_of(docs), items, k=2, shard=2, block=1) == brute(docs, items, 2)


def test_many_equal_documents_keep_the_smallest_ids(spark, docs_of):
    docs = [(i, "same text here") for i in range(300, 0, -1)] + [(i, f"other text {i}") for i in range(301, 340)]
    items = [(1, "same here"), (2, "text")]
    assert found(spark, docs_of(docs), items, shard=32, block=8) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark, docs_of):
    df = docs_of([(1, "a b"), (2, "b")]).selectExpr("*", "1 AS n", "2 AS ids", "3 AS Rank", "4 AS item")
    assert found(spark, df, [(1, "b")]) == brute([(1, "a b"), (2, "b")], [(1, "b")])
    assert found(spark, df.limit(0), [(1, "b")]) == []
    assert found(spark, df, []) == []


def test_blocks_bound_their_documents_and_are_skipped():
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 20, 2000)
    parts = (rng.integers(1, 1000, (2000, 60)) * ((np.arange(60) % 20 == topic[:, None]) | (rng.random((2000, 60)) < 0.02))).astype(np.int32)
    shard = Shard(parts, np.ones(60, np.float32), 64, 32)
    for t in range(60):
        docs, start, most = shard.blocks(t)
        assert sorted(docs) == np.flatnonzero(parts[:, t]).tolist()
        for j, (a, b) in enumerate(zip(start[:-1], start[1:])):
            assert b > a and (parts[docs[a:b]].max(0) == most[j]).all()
    query, weight = np.array([3, 23, 43]), np.array([5, 7, 9])
    best, score = shard.search(query, weight, np.arange(2000), 10)
    exact = (parts[:, query].astype(np.int64) * weight).sum(1)
    assert score.tolist() == sorted(exact.tolist(), reverse=True)[:10] and best.tolist() == np.lexsort((np.arange(2000), -exact))[:10].tolist()


def test_query_has_sql():
    assert "op11_lexical_search" in QUERIES and "op11_lexical_search" in ORACLE
