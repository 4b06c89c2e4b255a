"""MinHash near-duplicates with sequential Bayesian verification (operator 3).

1. One pass gives each document the size and digest of its set of distinct shingles and a MinHash
   signature.  Equal sets collapse to the smallest doc_id, so exact copies never meet in pairs.
2. Bands of the signature give candidate pairs.  The bands are chosen so that a pair at the
   threshold shares none with probability ``miss`` at most.
3. Signatures of a candidate pair are compared in batches; after each batch the pair goes if the
   posterior probability that its similarity reaches the threshold (uniform prior) is below
   ``miss``.  What survives is verified on the full sets.
4. Linked documents form components.  Within a bucket, pairs are made against a leader first (the
   smallest doc_id, then another); pairs of documents that are already in one component can't
   change the result and are never made.  For the documents of buckets that still hold several
   components all possible links are tried: with the shingles of each set in order of their
   frequency, linked sets share one of the first few, and what follows the first that they share
   must be enough for the threshold.  So no link between components is lost, without all pairs of
   a large group of copies, or of near misses.

Defined results: null text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle are one shingle, the whole sequence; a row without doc_id is linked
with nothing and kept; rows that repeat a doc_id are one document; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import kernels as K
from trustframe.llm.common import cut, map_arrow, register, table
from trustframe.llm.components import components

FILTER_BITS = 26  # the candidates' bit table: 8 MB, whatever the input


def shingle_sets(column, k: int):
    """Sorted distinct shingle hashes, text by text: (hashes end to end, offsets)."""
    data, off = K.flat(column)
    data = K.LOWER[data]
    start, end, first = K.spans(data, off)
    g, ok = K.windows(K.hashes(data, start, end), first, k, short=True)
    sets = [np.unique(g[a:b][ok[a:b]]) for a, b in zip(first[:-1], first[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def least_matches(hashes: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, fewest equal of the first n hashes): with fewer, P(similarity >= threshold) < miss.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in range(step, hashes + step, step):
        n = min(n, hashes)
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


@dataclass
class MinHashDedup:
    words: int = 5
    percent: int = 80
    band_rows: int = 5
    miss: float = 1e-6
    batch: int = 25
    seed: int = 11

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.band_rows))

    def signatures(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, digest, sig) of each document; digest and sig null for empty sets."""
        k, n = self.words, self.bands * self.band_rows
        rng = np.random.Generator(np.random.PCG64(self.seed))
        mul = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        add = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)

        def sign(batch):
            for part in K.slices(batch, 1):
                g, off = shingle_sets(part.column(1), k)
                size = np.diff(off)
                full = np.flatnonzero(size)
                sig = np.empty((len(full), n), np.uint32)
                if len(full):
                    low, cuts, x = (g >> np.uint64(32)).astype(np.uint32), off[full], np.empty(len(g), np.uint32)
                    for i in range(n):
                        np.multiply(low, mul[i], out=x)
                        x += add[i]
                        sig[:, i] = np.minimum.reduceat(x, cuts)
                digest, sigs = [None] * len(size), [None] * len(size)
                for row, d in enumerate(full.tolist()):
                    digest[d] = hashlib.blake2b(g[off[d]:off[d + 1]].tobytes(), digest_size=16).digest()
                    sigs[d] = sig[row].tobytes()
                yield [part.column(0), K.i64(size), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())]

        return map_arrow(docs, ["doc_id", "text"], sign, "doc_id long, n_shingles long, digest binary, sig binary")

    def banded(self, reps: DataFrame) -> DataFrame:
        """(key, id): the bucket of each band; the key holds the band."""
        bands, rows = self.bands, self.band_rows

        def run(batch):
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(rows):
                key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield [K.i64(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))]

        return map_arrow(reps, ["id", "sig"], run, "key long, id long")

    def likely(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs (a, b) that the sequential test keeps."""
        n = self.bands * self.band_rows
        tests = least_matches(n, self.batch, self.percent / 100, self.miss)

        def run(batch):
            if not batch.num_rows:
                return
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, n) for i in (2, 3))
            left, got, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for upto, least in tests:
                got[left] += (a[left, done:upto] == b[left, done:upto]).sum(1)
                left, done = left[got[left] >= least], upto
            yield [batch.column(0).take(pa.array(left)), batch.column(1).take(pa.array(left))]

        side = lambda c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return map_arrow(both, ["a", "b", "sig_a", "sig_b"], run, "a long, b long")

    def sets(self, ids: DataFrame, docs: DataFrame) -> DataFrame:
        """(id, shingles) of the documents with these ids, as a table.

        A bit table of fixed size over the ids spares the other documents most of the work (a
        false hit only costs work: the join is exact)."""
        spark, k = docs.sparkSession, self.words
        slot = F.expr(f"pmod(xxhash64(id), {1 << FILTER_BITS})")
        bits = (ids.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m")).toPandas())
        words = np.zeros((1 << FILTER_BITS) // 64, np.int64)
        words[bits["w"].to_numpy(np.int64)] = bits["m"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast(words.view(np.uint64))  # 8 MB

        def run(batch):
            s = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (shared.value[s // 64] >> (s % 64).astype(np.uint64)) & np.uint64(1)
            batch = batch.take(pa.array(np.flatnonzero(hit)))
            for part in K.slices(batch, 1):
                g, off = shingle_sets(part.column(1), k)
                yield [part.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(g.view(np.int64)))]

        own = map_arrow(docs.filter("doc_id IS NOT NULL").withColumn("id", F.col("doc_id")), ["id", "text", slot.alias("s")], run, "id long, shingles array<long>")
        return cut(own.join(ids.distinct(), "id", "left_semi"))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        joint = F.size("set_a") + F.size("set_b") - common
        return both.filter(100 * common >= self.percent * joint).select("a", "b")

    @staticmethod
    def _first_leaders(banded: DataFrame) -> DataFrame:
        """Pairs of each bucket's smallest id with the others."""
        head = banded.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("hi")).filter("head < hi").select("key", "head")
        return banded.join(head, "key").filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()

    @staticmethod
    def _next_leaders(mixed: DataFrame) -> DataFrame:
        """Pairs of another leader of each bucket with those of other components."""
        head = mixed.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id")).alias("h"))
        pairs = mixed.join(head.select("key", F.col("h.id").alias("head"), F.col("h.component").alias("hc")), "key").filter("component != hc")
        return pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()

    @staticmethod
    def _mixed(banded: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, id, component) of the buckets that hold more than one component."""
        b = banded.join(labels, "id")
        mixed = b.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        return cut(b.join(mixed, "key"))

    def _across(self, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """All pairs of the sets in different components that can reach the threshold.

        Rows are the first shingles of each set, rarest first, with what is left from there on.
        The largest component among a shingle's rows is met by the others only."""
        pc = self.percent
        each = sets.select("id", F.explode("shingles").alias("key"))
        ranked = (each.join(each.groupBy("key").agg(F.count("*").alias("c")), "key").groupBy("id")
                  .agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("s")).withColumn("n", F.size("s").cast("long")))
        rows = (ranked.select("id", "n", F.posexplode(F.expr(f"slice(s, 1, cast(n - ({pc} * n + 99) div 100 + 1 as int))")).alias("pos", "x"))
                .select("id", "n", (F.col("n") - F.col("pos")).alias("left"), "x.key", "x.c").filter("c > 1").drop("c").join(labels, "id"))
        rows = cut(rows)
        main = (rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
                .agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts"))
        b = rows.join(main, "key")
        side = lambda c: b.select("key", "main", *[F.col(x).alias(f"{x}_{c}") for x in ("id", "component", "n", "left")])
        pairs = side("a").filter("component_a != main").join(side("b").drop("main"), "key").filter(
            f"component_a != component_b AND (component_b = main OR id_a < id_b) AND {pc} * (n_a + n_b) <= {100 + pc} * least(left_a, left_b)")
        return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()

    def classes(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of each row."""
        docs = docs.select("doc_id", "text")
        signed = cut(self.signatures(docs))
        first = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"))
        reps = cut(signed.join(first, "digest").filter("doc_id = id").select("id", "sig").distinct())
        banded = self.banded(reps)
        ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        tried = cut(self.likely(self._first_leaders(banded), reps))
        links = cut(self.verified(tried, self.sets(ends(tried), docs)))
        labels = self._labels(reps, links)
        mixed = self._mixed(banded, labels)
        for last in (False, True):
            sets = self.sets(mixed.select("id"), docs) if last else None
            pairs = self._across(sets, labels) if last else self._next_leaders(mixed)
            new = cut(self.likely(pairs, reps).join(tried, ["a", "b"], "left_anti"))
            if new.isEmpty():
                continue
            tried = tried.union(new)
            more = cut(self.verified(new, sets if last else self.sets(ends(new), docs)))
            if not more.isEmpty():
                links = links.union(more)
                labels = self._labels(reps, links)
                mixed = mixed if last else self._mixed(banded, labels)
        out = (signed.drop("sig").join(first.withColumnRenamed("id", "rep"), "digest", "left")
               .join(labels.withColumnRenamed("id", "rep"), "rep", "left"))
        alone = F.col("doc_id").isNull() | F.col("digest").isNull()
        out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    @staticmethod
    def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
        return cut(reps.select("id").distinct().join(components(links), "id", "left")
                   .select("id", F.coalesce("component", "id").alias("component")))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """The documents without those that a smaller doc_id stands for."""
        gone = self.classes(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


@register("op3_minhash_bayes")
def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, similarity of 85 % or more."""
    return MinHashDedup(words=3, percent=85).classes(table(spark, sf_dir, "documents"))
