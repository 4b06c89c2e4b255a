"""Quality classifier: supervised subword embeddings (operator 12).

A text's features are its words and its character n-grams (3 and 4 code points, white space as one
kind of character), A-Z lower-cased, hashed into ``2^bits`` buckets; a word equal to the one before
also counts as one special word.  Each bucket has a learned
vector; a document is the average of its features' vectors, and a softmax over two classes scores
it.  Vectors and output weights are trained by stochastic gradient descent in numpy, a document at a
time, with a rate that falls to 0 over ``epochs``.  A bucket's step is divided by the document's sum
of squared feature shares, so a long text moves its score as far as a short one does.

The model is fitted on at most ``max_labels`` labelled documents, those with the smallest hash of
their id (a documented bound); they stream in a hash order of their own in each epoch through one
task, which holds the model and one batch.  What comes back has a fixed size.  For scoring, a
bucket's vector folds into one number, as the averaged vectors enter the softmax linearly; every
whole text of every document is scored.

Defined results: null or empty text has no features and the score of the bias alone; a null doc_id
is never learned from; a document labelled twice is of quality if one label says so; null
labels are ignored; without labels of both classes every score is the rate of what there is; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import kernels as K
from trustframe.llm.common import map_arrow, register, small_batches, table

GRAMS = (3, 4)
#: lower case, and every separator of words as one character
_PLAIN = K.LOWER.copy()
_PLAIN[~K.SPACED] = 0x20


def buckets(column, bits: int):
    """Feature buckets of the texts: (bucket, text) of each word and n-gram, in no order."""
    data, off = K.flat(column)
    data = _PLAIN[data]
    start, end, first = K.spans(data, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    fold = lambda h, n: (K.mix(h ^ np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
    words, doc = K.hashes(data, start, end), np.repeat(np.arange(len(off) - 1), np.diff(first))
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])) + 1
    out, of = [fold(words, 1), fold(np.zeros(len(again), np.uint64), 2)], [doc, doc[again]]
    chars = np.flatnonzero(K.CHAR[data])
    text = np.searchsorted(off, chars, "right") - 1
    ends = np.append(chars, len(data))
    for n in GRAMS:
        if len(chars) >= n:
            m = len(chars) - n + 1
            own = np.flatnonzero(text[:m] == text[n - 1:])
            out.append(fold(K.hashes(data, chars[own], ends[own + n]), n))
            of.append(text[own])
    return np.concatenate(out), np.concatenate(of)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Embeddings:
    """Bucket vectors and a softmax over two classes."""

    def __init__(self, bits: int, dim: int, seed: int = 12):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
        self.out = rng.normal(0, 1 / math.sqrt(dim), (2, dim))
        self.bias = np.zeros(2)

    def step(self, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
        """One document: cross-entropy of the softmax, descended once."""
        hidden = share @ self.vectors[ids]
        z = self.out @ hidden + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = p @ self.out
        self.out -= rate * np.outer(p, hidden)
        self.bias -= rate * 0.1 * p
        self.vectors[ids] -= (rate / (share @ share)) * share[:, None] * back

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of class 1, and the bias."""
        return (self.vectors @ (self.out[1] - self.out[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


@dataclass
class QualityClassifier:
    bits: int = 18
    dim: int = 16
    epochs: int = 3
    rate: float = 0.4
    max_labels: int = 4096

    def sample(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """(text, label, hash) of the documents to learn from."""
        own = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
               .filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(self.max_labels))
        return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", (F.col("quality") != 0).cast("int").alias("label"), "h")

    def fit(self, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
        """The log-odds that each bucket adds, and the bias."""
        rows = self.sample(docs, labels)
        bits, dim, rate = self.bits, self.dim, self.rate
        total = self.max_labels * self.epochs
        each = F.explode(F.sequence(F.lit(0), F.lit(self.epochs - 1))).alias("epoch")
        dealt = rows.select("text", "label", "h", each).withColumn("at", F.xxhash64("h", "epoch")).repartition(1).sortWithinPartitions("epoch", "at")

        def train(batches):
            model, done, count = Embeddings(bits, dim), 0, [0, 0]
            for batch in batches:
                for part in K.slices(batch, 0):
                    ids, of = buckets(part.column(0), bits)
                    key, n = np.unique((of << bits) | ids, return_counts=True)
                    edge = np.searchsorted(key >> bits, np.arange(part.num_rows + 1))
                    for i, label in enumerate(part.column(1).to_pylist()):
                        a, b = edge[i], edge[i + 1]
                        count[label] += 1
                        done += 1
                        if a < b:
                            model.step(key[a:b] & ((1 << bits) - 1), n[a:b] / n[a:b].sum(), label, rate * max(0.0, 1 - done / total))
            if not count[0] or not count[1]:
                weight, bias = np.zeros(1 << bits, np.float32), math.log((count[1] + 0.5) / (count[0] + 0.5))
            else:
                weight, bias = model.folded()
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()]), pa.array([bias])], names=["weight", "bias"])

        small_batches(docs.sparkSession)
        got = dealt.select("text", "label").mapInArrow(train, "weight binary, bias double").first()  # 4 bytes x 2^bits
        return (np.frombuffer(bytes(got["weight"]), np.float32), got["bias"]) if got else (np.zeros(1 << bits, np.float32), 0.0)

    def score(self, docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
        """doc_id and score (the softmax of class 1) of every document."""
        shared, bits = docs.sparkSession.sparkContext.broadcast(model), self.bits  # 1 MB

        def run(batch):
            weight, bias = shared.value
            for part in K.slices(batch, 1):
                ids, of = buckets(part.column(1), bits)
                n = np.bincount(of, minlength=part.num_rows)
                z = np.bincount(of, weight[ids], minlength=part.num_rows) / np.maximum(n, 1) + bias
                yield [part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))]

        return map_arrow(docs, [F.col("doc_id").cast("long"), "text"], run, "doc_id long, score double")


@register("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels outside the held-out fold."""
    docs, op = table(spark, sf_dir, "documents"), QualityClassifier()
    scored = op.score(docs, op.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
