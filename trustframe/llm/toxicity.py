"""Toxic passages as maximum-scoring segments of token log-odds (operator 9).

Training counts in how many toxic and clean labelled documents each token occurs.  A token is a
word or, if that is seldom seen, its first five code points; its rate of toxic documents has a
Dirichlet (two classes: Beta) prior centred on the rate of all.  Counts go into hash tables of
fixed size, so the model has the same few MB whatever the vocabulary.  A token's score is its
log-odds less ``drift``, so that clean text drifts down.

A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a document.  Scores are
calibrated as extreme values: lambda solves E[exp(lambda s)] = 1 over the tokens of clean
documents, K is fitted to the clean documents' best segments, and the segments of a document
together have the Karlin-Altschul sum statistic, whose -log P goes through a logistic function
fitted on labelled documents that the counts haven't seen.  A segment with lambda S > ln(K n) is
a significant passage.

The model is fitted on at most ``max_labels`` labelled documents, those with the smallest hash of
their id (a documented bound); scoring covers every document.  Defined results: null or empty
text has no passage and the score that goes with none; a null doc_id is held out; a document
labelled twice is toxic if one label says so; null labels are ignored; without labels of both
classes every score is the prior's; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import kernels as K
from trustframe.llm.common import map_arrow, register, table

WORD_BITS, PREFIX_BITS, PREFIX = 20, 18, 5


def tokens(column):
    """(start, end, first word of each text, word bucket, prefix bucket, bytes) of lower-cased words."""
    data, off = K.flat(column)
    data = K.LOWER[data]
    start, end, first = K.spans(data, off, K.ALNUM)
    if not len(start):
        z = np.zeros(0, np.int64)
        return start, end, first, z, z, data
    chars = np.append(np.flatnonzero(K.CHAR[data]), [len(data)] * (PREFIX + 1))
    near = np.minimum(chars[K.codepoints(data)[start] + PREFIX], end)
    bucket = lambda e, bits: (K.hashes(data, start, e) >> np.uint64(64 - bits)).astype(np.int64)
    return start, end, first, bucket(end, WORD_BITS), bucket(near, PREFIX_BITS), data


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left, right = total[at].tolist(), total[at + 1].tolist()
    out: list[list] = []  # start, end, sum before, sum after, the last segment that lies lower
    for i, lo, hi in zip(at.tolist(), left, right):
        s = [i, i + 1, lo, hi, -1]
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= s[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= s[3]:
                s[4] = j
                out.append(s)
                break
            s = [out[j][0], s[1], out[j][2], s[3], -1]
            del out[j:]
            j = len(out) - 1
    return [(a, b, r - x) for a, b, x, r, _ in out]


@dataclass
class Model:
    word: np.ndarray
    prefix: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -3.0

    def scores(self, word, prefix):
        """The word's log-odds; of a word that wasn't seen, its prefix's."""
        w = self.word[word]
        return np.where(np.isnan(w), self.prefix[prefix], w)

    def evidence(self, segs, n: int) -> float:
        """-log P of the best set of segments by their sum."""
        if not segs:
            return -10.0
        norm = sorted((self.lam * s - math.log(max(n, 1)) - self.log_k for _, _, s in segs), reverse=True)
        best, t, parts = norm[0], 0.0, 0.0
        for r, x in enumerate(norm, 1):
            if x <= 0:
                break
            t += x
            if r > 1:
                parts += math.log(r) + math.log(r - 1)
                best = max(best, t - (r - 1) * math.log(t) + parts - math.log(r))
        return max(best, -10.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


@dataclass
class ToxicPassages:
    drift: float = 1.2
    prior: float = 10.0
    word_prior: float = 10.0
    least_seen: int = 8  # documents with a word, below which its prefix stands for it
    max_labels: int = 200_000

    def labelled(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """(text, toxic, fold) of the labelled documents that may be learned from."""
        own = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
               .withColumn("fold", held_out(F.col("doc_id"))).filter("fold != 0")
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_labels))
        return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))

    def counts(self, rows: DataFrame) -> dict[int, np.ndarray]:
        """For words (0) and prefixes (1): toxic and clean documents by bucket; key 2 has the documents.

        Words that too few documents have for a score of their own aren't gathered."""

        def run(batches):
            sums = {0: np.zeros((2, 1 << WORD_BITS), np.int64), 1: np.zeros((2, 1 << PREFIX_BITS), np.int64), 2: np.zeros((2, 1), np.int64)}
            for batch in batches:
                for part in K.slices(batch, 0):
                    _, _, first, word, prefix, _ = tokens(part.column(0))
                    label = 1 - (part.column(1).to_numpy() != 0).astype(int)  # 0: toxic, 1: clean
                    doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                    for k, b, bits in ((0, word, WORD_BITS), (1, prefix, PREFIX_BITS)):
                        once = np.unique((doc << bits) | b)
                        np.add.at(sums[k], (label[once >> bits], once & ((1 << bits) - 1)), 1)
                    np.add.at(sums[2], (label, 0), 1)
            for k, s in sums.items():
                at = np.flatnonzero(s.sum(0))
                for i in range(0, len(at), 65536):
                    p = at[i:i + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k, np.int8)), pa.array(p.astype(np.int32)), pa.array(s[0, p]), pa.array(s[1, p])],
                                                     names=["kind", "bucket", "toxic", "clean"])

        got = (rows.select("text", "toxic").mapInArrow(run, "kind byte, bucket int, toxic long, clean long")
               .groupBy("kind", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .filter((F.col("kind") > 0) | (F.col("toxic") + F.col("clean") >= self.least_seen)).toPandas())  # at most 2^20 + 2^18 + 1 rows
        out = {}
        for k, size in ((0, 1 << WORD_BITS), (1, 1 << PREFIX_BITS), (2, 1)):
            own = got[got["kind"] == k]
            out[k] = np.zeros((2, size), np.float64)
            out[k][0, own["bucket"]], out[k][1, own["bucket"]] = own["toxic"], own["clean"]
        return out

    def fit(self, docs: DataFrame, labels: DataFrame) -> Model:
        rows = self.labelled(docs, labels)
        c = self.counts(rows.filter("fold != 4"))
        (toxic,), (clean,) = c[2]
        if not toxic or not clean:
            rate = (toxic + 0.5) / (toxic + clean + 10)
            return Model(np.full(1 << WORD_BITS, np.nan, np.float32), np.full(1 << PREFIX_BITS, -1.0, np.float32), slope=0.0, offset=math.log(rate / (1 - rate)))
        rate = toxic / (toxic + clean)
        odds = lambda p: np.log(p / (1 - p)) - math.log(rate / (1 - rate)) - self.drift
        prefix = (c[1][0] + self.prior * rate) / (c[1].sum(0) + self.prior)
        word = (c[0][0] + self.word_prior * rate) / (c[0].sum(0) + self.word_prior)
        seen = c[0].sum(0)
        model = Model(np.where(seen >= self.least_seen, odds(word), np.nan).astype(np.float32), odds(prefix).astype(np.float32))
        often = seen >= self.least_seen
        model.lam = self._lambda(odds(word[often]), c[0][1][often])
        check = self.passages(rows.filter("fold = 4"), model, ["toxic"]).select("toxic", "best", "n_tokens", "evidence")
        gap = (check.filter("toxic = 0 AND n_tokens > 0").agg(F.percentile_approx(F.lit(model.lam) * F.col("best") - F.log("n_tokens"), 0.5, 1_000_000)).first()[0])
        if gap is not None:
            model.log_k = gap + math.log(math.log(2))
        check = self.passages(rows.filter("fold = 4"), model, ["toxic"])
        bins = (check.groupBy(F.round(F.least("evidence", F.lit(200.0)) * 4).cast("int").alias("b"), (F.col("toxic") != 0).cast("int").alias("y"))
                .agg(F.count("*").alias("n")).toPandas())  # at most 2 x 841 rows
        if bins["y"].nunique() == 2:
            model.slope, model.offset = logistic(squashed(bins["b"].to_numpy() / 4.0), bins["y"].to_numpy(), bins["n"].to_numpy())
        return model

    @staticmethod
    def _lambda(scores: np.ndarray, weight: np.ndarray) -> float:
        """The positive root of E[exp(lambda s)] = 1 over clean tokens; 1 if there is none."""
        p = weight / max(weight.sum(), 1)
        f = lambda x: float((p * np.exp(np.minimum(x * scores, 500))).sum()) - 1
        if (p * scores).sum() >= 0 or scores.max(initial=0) <= 0:
            return 1.0
        lo, hi = 0.0, 0.5
        while f(hi) < 0 and hi < 50:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return hi

    def passages(self, docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
        """The kept columns, n_tokens, the best segment's score, the evidence, the document's score
        and its significant passages (start and end in code points, score)."""
        shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, 5 MB
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

        def run(batch):
            m = shared.value
            for part in K.slices(batch, 0):
                start, end, first, word, prefix, data = tokens(part.column(0))
                scores = m.scores(word, prefix).astype(np.float64)
                _, off = K.flat(part.column(0))
                chars = K.codepoints(data)
                best, evidence, found = [], [], []
                for i in range(part.num_rows):
                    a, b = int(first[i]), int(first[i + 1])
                    segs = segments(scores[a:b])
                    best.append(max((s for _, _, s in segs), default=0.0))
                    evidence.append(m.evidence(segs, b - a))
                    least = math.log(max(b - a, 1)) + m.log_k
                    zero = int(chars[off[i]])
                    found.append([{"start": int(chars[start[a + x]]) - zero, "end": int(chars[end[a + y - 1]]) - zero, "score": s}
                                  for x, y, s in segs if m.lam * s > least])
                e = np.array(evidence)
                score = 1 / (1 + np.exp(-np.clip(m.slope * squashed(e) + m.offset, -500, 500)))
                yield [*part.columns[1:], K.i64(np.diff(first)), pa.array(best, pa.float64()), pa.array(e), pa.array(score), pa.array(found, kind)]

        types = dict(docs.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_tokens long", "best double", "evidence double", "score double",
                                                                "passages array<struct<start:int,end:int,score:double>>"])
        return map_arrow(docs, ["text", *keep], run, schema)


    def clean(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The documents that aren't predicted toxic, with their columns."""
        model = self.fit(docs, labels)
        own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        scored = self.passages(docs.select(F.col("text"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()]), model, list(own.values()))
        return scored.filter("score < 0.5").select(*[F.col(n).alias(c) for c, n in own.items()])


def squashed(evidence: np.ndarray) -> np.ndarray:
    """Evidence on a scale where the logistic curve fits: its sign times log(1 + size)."""
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted points: Newton steps, halved until the
    penalised likelihood grows."""
    n = n.astype(float)

    def loss(v):
        z = v[0] * x + v[1]
        return (n * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * (v * v).sum()

    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -500, 500)))
        g = np.array([(n * (p - y) * x).sum(), (n * (p - y)).sum()]) + 0.1 * v
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 0.1 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(v[0], 1e-3)), float(v[1])


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels outside the held-out fold."""
    docs, op = table(spark, sf_dir, "documents"), ToxicPassages()
    model = op.fit(docs, table(spark, sf_dir, "labels"))
    return op.passages(docs, model, ["doc_id"]).select(
        "doc_id", (held_out(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
