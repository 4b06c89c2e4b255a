import random
import re

import pytest

from trustframe.llm.components import components
from trustframe.llm.neardup import MinHashDedup, least_matches

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, pc):
    sets = []
    for d, t in rows:
        w = W.findall((t or "").translate(LOW))
        sets.append((d, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    label = {d: d for d, _ in sets if d is not None}
    while True:
        moved = False
        for i, (a, s) in enumerate(sets):
            for b, t in sets[:i]:
                if a is None or b is None or not s or not t or label[a] == label[b] or 100 * len(s & t) < pc * len(s | t):
                    continue
                lo, hi = sorted((label[a], label[b]))
                label = {x: lo if y == hi else y for x, y in label.items()}
                moved = True
        if not moved:
            break
    return sorted(((d, len(s), label.get(d), d is None or label[d] == d) for d, s in sets), key=repr)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("k,pc", [(3, 85), (5, 80)])
def test_classes_match_brute_force(spark, docs_of, k, pc):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([60, 120, 200]))] for _ in range(6)]
    rows = [(rng.randrange(10**6) * 1000 + i, edited(rng, rng.choice(base), rng.randrange(5))) for i in range(220)]
    rows += [(-5, None), (-4, ""), (-3, " \n "), (-2, "one two"), (-1, "ONE two"), (1, "One  Two"), (2, "É a"), (3, "é a"), (4, "solo"), (6, "solo"),
             (None, "one two"), (7, "a b " * 3000), (8, "A B " * 2999)]
    got = MinHashDedup(words=k, percent=pc).classes(docs_of(rows).selectExpr("*", "1 AS id", "2 AS digest")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, pc)


def test_group_of_near_misses_is_exact(spark, docs_of):
    """Copies of one text, each changed so that most pairs just miss the threshold."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 4 + i % 9)) for i in range(260)]
    got = MinHashDedup(words=3, percent=85).classes(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3, 85)


def test_dedup_keeps_columns_and_one_of_each_group(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs_of([(3, text), (1, text), (2, text + " more"), (4, "other words here"), (None, text), (9, None)]).selectExpr("*", "0 AS kept", "1 AS _gone")
    out = MinHashDedup().dedup(df)
    assert out.columns == df.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, 1), (False, 4), (False, 9), (True, None)]
    assert MinHashDedup().dedup(df.limit(0)).count() == 0


def test_sequential_test_misses_rarely():
    tests = least_matches(120, 25, 0.85, 1e-6)
    assert [n for n, _ in tests] == [25, 50, 75, 100, 120]
    assert all(0 < m < 0.85 * n for n, m in tests)
    assert MinHashDedup(words=3, percent=85).bands == 24
    rng, lost = random.Random(1), 0
    for _ in range(3000):
        hits = [rng.random() < 0.85 for _ in range(120)]
        lost += any(sum(hits[:n]) < m for n, m in tests)
    assert lost == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 8), (9, 8), (9, 3), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and [got[i] for i in (3, 7, 8, 9)] == [3] * 4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
