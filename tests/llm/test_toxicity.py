import random
import zlib

import numpy as np
import pytest

from trustframe.llm.common import QUERIES
from trustframe.llm.toxicity import Model, ToxicPassages, logistic, segments


def all_maximal(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12 or (at and abs(s - best) < 1e-12 and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return all_maximal(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in all_maximal(scores[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-1, -0.7, -0.31, 0.53, 1.17]) * (1 + rng.random() / 1000) for _ in range(rng.randrange(25))]
    got = segments(np.array(scores))
    want = all_maximal(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_logistic_fits():
    x = np.repeat(np.arange(-5, 6), 2).astype(float)
    y = np.tile([0, 1], 11)
    p = 1 / (1 + np.exp(-(1.5 * np.arange(-5, 6) - 1)))
    n = np.ravel(np.column_stack([1 - p, p])) * 10000
    assert np.allclose(logistic(x, y, n), (1.5, -1), atol=0.02)


def corpus(n):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["Nasty", "vile", "rotten", "awful!"]) for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_query_learns_and_marks_passages(spark, docs_of, save):
    rows, labels = corpus(900)
    extra = [(5000, None), (5001, ""), (5002, "..."), (None, "vile rotten nasty"), (5003, "word1 " * 50000), (5003, "x")]
    lab = spark.createDataFrame(labels + [(0, 1, 0), (9999, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    sf = save(documents=docs_of(rows + extra).selectExpr("*", "1 AS score", "2 AS toxic", "3 AS fold"), labels=lab)
    got = QUERIES["op9_toxicity"](spark, sf).collect()
    assert len(got) == len(rows) + len(extra)
    toxic = {d for d, _, t in labels if t}
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] in toxic) for r in held]) >= 0.98
    text = dict(rows)
    found = [r for r in held if r["doc_id"] in toxic]
    hits = [any(w in text[r["doc_id"]][p["start"]:p["end"]] for w in ("Nasty", "vile", "rotten", "awful") for p in r["passages"]) for r in found]
    assert np.mean(hits) >= 0.95
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (5000, 5001, 5002))


def test_held_out_labels_are_not_used(spark, docs_of):
    rows, labels = corpus(400)
    lab = lambda ls: spark.createDataFrame(ls, "doc_id long, quality int, toxic int")
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    one, two = (ToxicPassages().fit(docs_of(rows), lab(x)) for x in (labels, flipped))
    assert np.array_equal(one.word, two.word, equal_nan=True) and (one.lam, one.log_k, one.slope, one.offset) == (two.lam, two.log_k, two.slope, two.offset)


def test_no_labels_one_class_and_empty(spark, docs_of):
    lab = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    df = docs_of([f"text number {i}" for i in range(20)]).selectExpr("*", "1 AS score", "2 AS c0")
    for labels in (lab, lab.limit(0)):
        out = ToxicPassages().clean(df, labels)
        assert out.columns == df.columns and out.count() == 20
    assert ToxicPassages().clean(df.limit(0), lab).count() == 0


def test_evidence_grows_with_segments():
    m = Model(np.zeros(1), np.zeros(1))
    assert m.evidence([], 10) == -10
    assert m.evidence([(0, 1, 9.0), (3, 4, 9.0)], 10) > m.evidence([(0, 1, 9.0)], 10) > m.evidence([(0, 1, 2.0)], 10)
