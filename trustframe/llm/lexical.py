"""Ranked lexical search over per-term geometric blocks (operator 11).

The items come in sets of at most about ``set_bytes`` of text; a set's terms are known to every
task.  One pass over the documents gives each its length and its counts of those terms (a row of a
forward table), from which follow the numbers of documents and terms and the document frequencies.

A task then reads the forward table in shards of ``shard`` documents.  In a shard every term's
posting list is cut into geometric blocks: a few of its documents stand as representatives, spread
over the list, and each document joins the most similar one (inner product of random projections of
their term weights).  A block stores the coordinatewise maximum of its documents' term parts.  For
an item the inner product with a block's maxima bounds the score of every document in it, exactly
and in integers.  Blocks of all the item's lists are taken by falling bound, the documents not yet
seen are scored exactly, and a block is skipped only when its bound is below the score of the
k-th document so far (or 0).  So the best of a shard are exact, and a top-k by item merges shards.

Nothing is shuffled but each task's best: no term, however frequent, meets in one task.  The
vocabulary is worked on in groups of items with at most ``group`` terms, so a shard's maxima and
parts have a fixed size.

Terms are compared by a 64-bit hash and then by their bytes.  Defined results: null text, or one
without terms, is no document that counts, and an item without terms has no result; equal scores
are ordered by doc_id (nulls last); repeated rows of either table are rows of their own (an item_id
on two rows has two rankings); documents of score 0 are never returned; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trustframe.llm import kernels as K
from trustframe.llm.common import cut, map_arrow, register, small_batches, table


def terms_of(column):
    """(lower-cased bytes, start, end, index of each text's first term, term hashes)."""
    data, off = K.flat(column)
    data = K.LOWER[data]
    start, end, first = K.spans(data, off, K.ALNUM)
    return data, start, end, first, K.hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)


class Vocabulary:
    """The terms of a set of items; a term's id is its place by hash."""

    def __init__(self, texts: list):
        data, start, end, first, h = terms_of(pa.array(texts, pa.string()))
        self.hashes, place = np.unique(h, return_index=True)
        raw = data.tobytes()
        own = [raw[a:b] for a, b in zip(start[place].tolist(), end[place].tolist())]
        self.size = np.array([len(x) for x in own], np.int64)
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True
        ids = np.searchsorted(self.hashes, h)
        #: for each item its term ids and how often it has them
        self.items = [np.unique(ids[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]

    def find(self, data, start, end, h):
        """(places, ids) of the terms that are in the vocabulary, byte for byte."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        ids = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = (self.hashes[ids] == h[at]) & (self.size[ids] == end[at] - start[at])
        at, ids = at[same], ids[same]
        good, size = np.ones(len(at), bool), self.size[ids]
        for k in range(int(size.max(initial=0))):
            own = np.flatnonzero(size > k)
            good[own] &= data[start[at[own]] + k] == self.bytes[self.at[ids[own]] + k]
        return at[good], ids[good]


def counts(column, words: Vocabulary):
    """n of each text, and its vocabulary terms: (n, offsets, ids, tf)."""
    data, start, end, first, h = terms_of(column)
    at, ids = words.find(data, start, end, h)
    doc = np.searchsorted(first, at, "right") - 1
    key, tf = np.unique(doc * max(1, len(words.hashes)) + ids, return_counts=True)
    doc, ids = np.divmod(key, max(1, len(words.hashes)))
    return np.diff(first), np.searchsorted(doc, np.arange(len(first))), ids, tf


class Shard:
    """Some documents over a group's terms: parts (documents x terms) and the blocks of each list."""

    def __init__(self, parts: np.ndarray, weight: np.ndarray, block: int, width: int):
        self.parts, self.block = parts, block
        rng = np.random.Generator(np.random.PCG64(11))
        near = (parts * weight).astype(np.float32) @ rng.choice(np.array([-1, 1], np.float32), (parts.shape[1], width))
        self.near = near / np.maximum(np.sqrt((near * near).sum(1, keepdims=True)), 1e-30)
        self.lists: dict[int, tuple] = {}

    def blocks(self, term: int):
        """(documents by block, starts of the blocks, maxima of each block) of a posting list."""
        if term not in self.lists:
            docs = np.flatnonzero(self.parts[:, term])
            heads = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // self.block)).astype(np.int64)]
            own = np.argmax(self.near[docs] @ self.near[heads].T, axis=1) if len(heads) else docs
            order = np.argsort(own, kind="stable")
            docs, own = docs[order], own[order]
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(docs) else docs
            most = np.maximum.reduceat(self.parts[docs], start, axis=0) if len(docs) else self.parts[:0]
            self.lists[term] = docs, np.append(start, len(docs)), most
        return self.lists[term]

    def search(self, terms: np.ndarray, weight: np.ndarray, ident: np.ndarray, k: int):
        """(documents, scores) of the k best of the shard; ``ident`` orders equal scores."""
        lists = [self.blocks(t) for t in terms.tolist()]
        bound = np.concatenate([(most[:, terms].astype(np.int64) * weight).sum(1) for _, _, most in lists])
        of = np.concatenate([np.full(len(s) - 1, i) for i, (_, s, _) in enumerate(lists)])
        number = np.concatenate([np.arange(len(s) - 1) for _, s, _ in lists])
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(len(self.parts), bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, least = 0, 4, 1
        while at < len(order) and bound[order[at]] >= least:  # the bounds fall: the rest are skipped
            take = order[at:at + step]
            take = take[bound[take] >= least]
            at, step = at + step, min(2 * step, 256)
            docs = np.concatenate([lists[i][0][lists[i][1][j]:lists[i][1][j + 1]] for i, j in zip(of[take].tolist(), number[take].tolist())])
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            s = (self.parts[np.ix_(docs, terms)].astype(np.int64) * weight).sum(1)
            best, score = np.concatenate([best, docs]), np.concatenate([score, s])
            top = np.lexsort((ident[best], -score))[:k]
            best, score = best[top], score[top]
            best, score = best[score > 0], score[score > 0]
            if len(best) == k:
                least = max(1, int(score[-1]))  # an equal score with a smaller id may still come
        return best, score


@dataclass
class LexicalSearch:
    k: int = 10
    shard: int = 4096  # documents of a shard, and
    postings: int = 1 << 19  # terms of all of them, whichever comes first
    block: int = 64  # documents of a geometric block, on average
    width: int = 32  # of the projections that tell similar documents
    group: int = 2048  # terms of a group of items
    set_bytes: int = 4 << 20  # text of a set of items

    def _groups(self, words: Vocabulary) -> list[list[int]]:
        """Items in runs with at most ``group`` different terms (an item with more is a run)."""
        out, own, known = [], [], set()
        for i, (ids, _) in enumerate(words.items):
            if not len(ids):
                continue
            more = known | set(ids.tolist())
            if own and len(more) > self.group:
                out.append(own)
                own, more = [], set(ids.tolist())
            own.append(i)
            known = more
        return [*out, own] if own else out

    def forward(self, docs: DataFrame, words: Vocabulary) -> DataFrame:
        """doc_id, n and the vocabulary terms (ids, tf) of every document with a term."""
        shared = docs.sparkSession.sparkContext.broadcast(words)  # one set of items

        def run(batch):
            for part in K.slices(batch, 0):
                n, off, ids, tf = counts(part.column(0), shared.value)
                off = pa.array(off, pa.int32())
                yield [part.column(1), K.i64(n), pa.ListArray.from_arrays(off, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(off, pa.array(tf, pa.int64()))]

        return map_arrow(docs, ["text", F.col("doc_id").cast("long")], run, "doc_id long, n long, ids array<int>, tf array<bigint>").filter("n > 0")

    def weights(self, forward: DataFrame, n_docs: int, size: int) -> np.ndarray:
        """The weight of each term of the vocabulary (0 for those that no document has)."""
        df = forward.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
        got = df.select("id", F.expr(f"cast(floor(1000 * ln(cast(2 * {n_docs}L + 2 AS double) / cast(2 * df + 1 AS double))) AS long)").alias("w")).toPandas()
        out = np.zeros(size, np.int64)  # one set's terms
        out[got["id"]] = got["w"]
        return out

    def _ranked(self, docs: DataFrame, items: list) -> DataFrame:
        """item (its place in the set), doc_id, score: the best of each task's shards."""
        spark, words = docs.sparkSession, Vocabulary([t for _, t in items])
        forward = cut(self.forward(docs, words))
        n_docs, length = forward.agg(F.count("*"), F.sum("n")).first()
        weight = self.weights(forward, n_docs, len(words.hashes))
        shared = spark.sparkContext.broadcast((words.items, weight, self._groups(words)))
        k, size, most, block, width, length = self.k, self.shard, self.postings, self.block, self.width, max(1, length or 0)

        def best(held):
            """The shard's best for every item."""
            doc_id = pa.concat_arrays([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            many = np.concatenate([x[2] for x in held])
            ids, tf = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            row = np.repeat(np.arange(len(n)), many)
            m = 25 + np.array([75 * int(x) * n_docs // length for x in n], np.int64)
            part = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            none = np.asarray(doc_id.is_null())
            ident = np.where(none, 2**63 - 1, doc_id.fill_null(0).to_numpy(zero_copy_only=False))
            every, w, groups = shared.value
            out = [[], [], []]
            for group in groups:
                own = np.unique(np.concatenate([every[i][0] for i in group]))
                own = own[w[own] > 0]
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
                mine = own[at] == ids
                parts = np.zeros((len(n), len(own)), np.int32)  # a part is below 10^6
                parts[row[mine], at[mine]] = part[mine]
                shard = Shard(parts, w[own].astype(np.float32), block, width)
                for i in group:
                    terms, times = every[i]
                    good = w[terms] > 0
                    if good.any():
                        docs_, score = shard.search(np.searchsorted(own, terms[good]), (w[terms] * times)[good], ident, k)
                        out[0].append(np.full(len(docs_), i, np.int32))
                        out[1].append(docs_)
                        out[2].append(score)
            if not out[0]:
                return
            item, docs_, score = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays([pa.array(item), doc_id.take(pa.array(docs_)), pa.array(score)], names=["item", "doc_id", "score"])

        def run(batches):
            held, rows, terms = [], 0, 0
            for batch in batches:
                total = batch.column(2).offsets.to_numpy()
                at = 0
                while at < batch.num_rows:
                    end = min(at + size - rows, max(at + 1, int(np.searchsorted(total, total[at] + most - terms, "right")) - 1), batch.num_rows)
                    part = batch.slice(at, end - at)
                    ids, tf = part.column(2), part.column(3)
                    held.append((part.column(0), part.column(1).to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), tf.flatten().to_numpy()))
                    at, rows, terms = end, rows + part.num_rows, terms + int(total[end] - total[at])
                    if rows >= size or terms >= most or at < batch.num_rows:
                        yield from best(held)
                        held, rows, terms = [], 0, 0
            if held:
                yield from best(held)

        small_batches(spark)
        return forward.mapInArrow(run, "item int, doc_id long, score long")

    def search(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """item_id, rank, doc_id, score: the k best documents of each item."""
        items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sets = max(1, -(-total // self.set_bytes))
        held = cut(items.withColumn("set", F.expr(f"pmod(xxhash64(item_id, text), {sets})")).repartition("set")) if sets > 1 else items.withColumn("set", F.lit(0))
        out = None
        for i in range(sets):
            own = [tuple(r) for r in held.filter(F.col("set") == i).select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]  # a set
            first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            got = self._ranked(docs, own).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= self.k)
            names = docs.sparkSession.createDataFrame([(j, r[0]) for j, r in enumerate(own)], "at int, item_id long")
            got = got.join(F.broadcast(names), F.col("item") == F.col("at")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            got = cut(got) if sets > 1 else got  # each set is its own job
            out = got if out is None else out.union(got)
        return out


OP11_SQL = r"""
WITH p AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS pattern),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT pattern FROM p)) AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS nn, sum(n) AS ll FROM n),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT pattern FROM p))) AS term FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term, nn),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN tf USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@register("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return LexicalSearch(k=10).search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
