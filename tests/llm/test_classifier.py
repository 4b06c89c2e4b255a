import zlib

import numpy as np
import pyarrow as pa
import pytest

from trustframe.llm import kernels as K
from trustframe.llm.classifier import GRAMS, Embeddings, QualityClassifier, buckets
from trustframe.llm.common import QUERIES


def test_features_are_words_and_grams_of_whole_texts():
    def feature(x, n):
        b = x.encode()
        data = np.frombuffer(b, np.uint8)
        return int(K.mix(K.hashes(data, np.array([0]), np.array([len(b)])) ^ np.uint64(n))[0] >> np.uint64(46))

    texts = ["Hé llo\nhé llo", "", "ab", None, "x " * 2000, "é\té"]
    ids, of = buckets(pa.array(texts, pa.string()), 18)
    for i, t in enumerate(texts):
        t = "".join(" " if c in " \t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        want = [feature(w, 1) for w in t.split()] + [feature(t[j:j + n], n) for n in GRAMS for j in range(len(t) - n + 1)]
        again = int(K.mix(np.zeros(1, np.uint64) ^ np.uint64(2))[0] >> np.uint64(46))
        want += [again] * sum(a == b for a, b in zip(t.split(), t.split()[1:]))
        assert sorted(ids[of == i].tolist()) == sorted(want if t.split() else [])


def test_step_descends_the_cross_entropy():
    m = Embeddings(6, 4)
    ids, share = np.array([1, 5, 9]), np.array([0.5, 0.25, 0.25])

    def loss(label):
        z = m.out @ (share @ m.vectors[ids]) + m.bias
        return np.log(np.exp(z).sum()) - z[label]

    h, z = share @ m.vectors[ids], m.out @ (share @ m.vectors[ids]) + m.bias
    p = np.exp(z) / np.exp(z).sum()
    p[0] -= 1
    before, vectors, out = loss(0), m.vectors.copy(), m.out.copy()
    m.step(ids, share, 0, 0.01)
    assert loss(0) < before
    assert np.allclose(out - m.out, 0.01 * np.outer(p, h))
    assert np.allclose(vectors[ids] - m.vectors[ids], 0.01 / (share @ share) * np.outer(share, p @ out))
    weight, bias = m.folded()
    z = m.out @ (share @ m.vectors[ids]) + m.bias
    assert weight[ids] @ share + bias == pytest.approx(z[1] - z[0], abs=1e-6)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op12_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(i) for i, r in got.items())
    own = [(got[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r["doc_id"])]
    good, bad = [s for s, q in own if q == 1], [s for s, q in own if q == 0]
    assert len(own) > 100 and bad
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in own]) > 0.95


def test_labels_of_the_held_out_fold_and_other_columns_are_not_read(spark, docs_of):
    text = ["fine words of prose here", "junk | junk | junk |"]
    docs = docs_of([(i, text[i % 2] + f" {i}") for i in range(200)])
    label = lambda flip: spark.createDataFrame([(i, (i + 1) % 2 if not (flip and held(i)) else i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    op = QualityClassifier()
    run = lambda d, x: sorted(tuple(r) for r in op.score(d, op.fit(d, x)).collect())
    a = run(docs, label(False))
    assert a == run(docs.selectExpr("doc_id", "text", "'z' AS lang", "'y' AS source", "7 AS quality", "1 AS H", "2 AS epoch"), label(True))
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in a)


def test_nulls_empty_tables_and_one_class(spark, docs_of):
    op = QualityClassifier()
    docs = docs_of([(1, "a b"), (2, None), (3, ""), (None, "a"), (2, "again"), (5, "w " * 50000)])
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1), (7, 0, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = op.score(docs, op.fit(docs, labels)).collect()
    assert len(got) == 6 and len({r["score"] for r in got}) == 1 and got[0]["score"] >= 0.5
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels)).count() == 0
    assert {r["score"] for r in op.score(docs, op.fit(docs, labels.limit(0))).collect()} == {0.5}
