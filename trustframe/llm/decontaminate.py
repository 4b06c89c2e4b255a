"""Benchmark decontamination: SimHash of item-sized windows in a multi-index (operator 7).

Words are runs of letters and digits, A-Z lower-cased.  For every length that benchmark items
have, the windows of that many words at every place of every document are compared with the items
of that length.  A window's 128-bit SimHash over its 5-word shingles is looked up in a multi-index:
the fingerprint is cut into 8 blocks of 16 bits, and two fingerprints within the radius of 31 agree
in one block up to 3 bits, so the tables of block values within 3 bits of an item's miss none.
Candidates within the radius are verified by the exact weighted similarity: sum of the smaller over
sum of the larger shingle counts, ``percent`` or more.

Windows that can't reach it are left out before they are fingerprinted, by a bound that loses none:
``percent`` of a window's shingles at least must be shingles of some item of its length.

The items are taken in blocks of ``block_bytes`` of text at most, one pass over the documents each,
so what is sent to the tasks is bounded whatever the benchmark's size.  Nothing is shuffled.

Defined results: null text has no words; items without words match nothing; an item of fewer words
than a shingle matches where its whole sequence stands; equal items are found each; null ids are
carried along; repeated rows are rows of their own; empty tables give no match; with columns that
clash the added one gets a trailing underscore.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import kernels as K
from trustframe.llm.common import fresh, map_arrow, register, table

BLOCKS, BLOCK_BITS = 8, 16
MATCHES = "array<struct<item_id:long,start:int,n_words:int,similarity:double,distance:int>>"


def words_of(column):
    """(word hashes, first word of each text)."""
    data, off = K.flat(column)
    data = K.LOWER[data]
    start, end, first = K.spans(data, off, K.ALNUM)
    return K.hashes(data, start, end), first


def simhash(shingles: np.ndarray) -> np.ndarray:
    """128-bit fingerprints (as 16 bytes) of rows of shingle hashes."""
    two = np.stack([K.mix(shingles.copy()), K.mix(shingles ^ np.uint64(0xA5A5_5A5A_C3C3_3C3C))], axis=-1)
    bits = np.unpackbits(np.ascontiguousarray(two).view(np.uint8).reshape(*shingles.shape, 16), axis=-1)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > shingles.shape[1], axis=-1)


class HammingIndex:
    """All fingerprints within a radius: pigeonhole over blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints.view(np.uint64).reshape(-1, 2), radius
        near = [0] + [sum(1 << b for b in c) for n in range(1, radius // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), n)]
        self.tables = np.zeros((BLOCKS, 1 << BLOCK_BITS), bool)
        for b, values in enumerate(prints.view(np.uint16).reshape(-1, BLOCKS).T):
            for v in set(values.tolist()):
                self.tables[b, v ^ np.array(near)] = True

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) for all that lie within the radius."""
        values = prints.view(np.uint16).reshape(-1, BLOCKS)
        hit = np.zeros(len(values), bool)
        for b in range(BLOCKS):
            hit |= self.tables[b, values[:, b]]
        out, rows = [], np.flatnonzero(hit)
        p = prints.view(np.uint64).reshape(-1, 2)
        step = max(1, (1 << 20) // max(1, len(self.prints)))
        for i in range(0, len(rows), step):
            r = rows[i:i + step]
            d = np.bitwise_count(p[r][:, None, :] ^ self.prints[None]).sum(-1)
            a, b = np.nonzero(d <= self.radius)
            out += zip(r[a].tolist(), b.tolist(), d[a, b].tolist())
        return out


class ItemIndex:
    """A block of benchmark items, by length in words."""

    def __init__(self, ids: list, texts: list, k: int, radius: int):
        words, first = words_of(pa.array(texts, pa.string()))
        by_size: dict[int, list] = {}
        for i, item in enumerate(ids):
            w = words[first[i]:first[i + 1]]
            if len(w):
                own = min(k, len(w))
                g, ok = K.windows(w, np.array([0, len(w)]), own)
                by_size.setdefault(len(w), []).append((item, g[ok]))
        self.k, self.sizes, vocabulary = k, {}, {}
        for n, items in by_size.items():
            prints = np.concatenate([simhash(g[None]) for _, g in items])
            own = np.unique(np.concatenate([g for _, g in items]))
            self.sizes[n] = (HammingIndex(prints, radius), [i for i, _ in items], [Counter(g.tolist()) for _, g in items], own)
            vocabulary.setdefault(min(k, n), []).append((n, own))
        #: by shingle length: sorted hashes, and for each the lengths of the items that have it
        self.vocabulary = {}
        for s, lists in vocabulary.items():
            h, n = np.concatenate([v for _, v in lists]), np.concatenate([np.full(len(v), n) for n, v in lists])
            order = np.lexsort((n, h))
            bits = np.zeros(1 << 20, bool)
            bits[h >> np.uint64(44)] = True
            self.vocabulary[s] = (h[order], n[order], bits)

    def matches(self, column, percent: int) -> list[list[dict]]:
        """For each text its items, each with its best window (the first of equals)."""
        words, first = words_of(column)
        best: list[dict] = [{} for _ in range(len(first) - 1)]
        for s, (known, sizes, bits) in self.vocabulary.items():
            g, ok = K.windows(words, first, s)
            at = np.flatnonzero(bits[g >> np.uint64(44)] & ok)
            lo, hi = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(at):
                continue
            # (place, item length) of every shingle that items of that length have
            place = np.repeat(at, hi - lo)
            size = sizes[np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - hi + lo, hi - lo) + np.repeat(lo, hi - lo)]
            doc = np.searchsorted(first, place, "right") - 1
            order = np.lexsort((place, size))
            place, size, doc = place[order], size[order], doc[order]
            for n in np.unique(size).tolist():
                own = size == n
                self._size(n, g, first, place[own], doc[own], percent, best)
        return [sorted(b.values(), key=lambda m: (m["start"], m["item_id"] is None, m["item_id"] or 0)) for b in best]

    def _size(self, n: int, g, first, place, doc, percent: int, best: list[dict]) -> None:
        m = n - min(self.k, n) + 1
        need = -(-percent * m // 100)
        if len(place) < need:
            return
        # a window that holds enough of the shingles starts at most m - 1 before the first of `need` of them
        j = np.arange(len(place) - need + 1)
        dense = (place[j + need - 1] - place[j] < m) & (doc[j] == doc[j + need - 1])
        head, tail = place[j[dense]], place[j[dense] + need - 1]
        if not len(head):
            return
        # all windows around these runs, in bounds
        d = doc[j[dense]]
        lo, hi = np.maximum(tail - m + 1, first[d]), np.minimum(head, first[d + 1] - n)
        ok = hi >= lo
        if not ok.any():
            return
        lo, hi = lo[ok], hi[ok]
        reps = hi - lo + 1
        starts = np.unique(np.repeat(lo - np.cumsum(reps) + reps, reps) + np.arange(reps.sum()))
        index, ids, counts, _ = self.sizes[n]
        step = max(1, (1 << 14) // m)
        for i in range(0, len(starts), step):
            part = starts[i:i + step]
            shingles = g[part[:, None] + np.arange(m)]
            for row, item, distance in index.within(simhash(shingles)):
                c = Counter(shingles[row].tolist())
                small = sum((c & counts[item]).values())
                large = 2 * m - small
                if 100 * small >= percent * large:
                    at = int(part[row])
                    doc_at = int(np.searchsorted(first, at, "right")) - 1
                    key, sim = (n, item), small / large
                    old = best[doc_at].get(key)
                    if old is None or (-sim, at - int(first[doc_at])) < (-old["similarity"], old["start"]):
                        best[doc_at][key] = {"item_id": ids[item], "start": at - int(first[doc_at]), "n_words": n, "similarity": sim, "distance": distance}


@dataclass
class Decontaminator:
    words: int = 5
    percent: int = 80
    radius: int = 31
    block_bytes: int = 8 << 20

    def blocks(self, benchmark: DataFrame):
        """The items' indexes, block after block."""
        items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = -(-total // self.block_bytes)
        for i in range(n):
            rows = items.filter(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {i}")).collect()  # about block_bytes
            if rows:
                rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
                yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], self.words, self.radius)

    def mark(self, docs: DataFrame, benchmark: DataFrame, column: str = "matches", keep: list[str] | None = None) -> tuple[DataFrame, str]:
        """The rows with their matches (item_id, start and length in words, similarity, distance),
        and the name of that column.  ``keep``: the columns to keep, all if None."""
        column, text = fresh(docs, column, "_text")
        types, keep = dict(docs.dtypes), docs.columns if keep is None else keep
        out = docs.select(F.col("text").alias(text), *keep).withColumn(column, F.array().cast(MATCHES))
        percent = self.percent
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64()), ("distance", pa.int32())]))
        for index in self.blocks(benchmark):
            shared = docs.sparkSession.sparkContext.broadcast(index)

            def run(batch, shared=shared):
                for part in K.slices(batch, 0):
                    found = shared.value.matches(part.column(0), percent)
                    old = part.column(part.num_columns - 1).to_pylist()
                    yield [*part.columns[:-1], pa.array([a + b for a, b in zip(old, found)], kind)]

            schema = ", ".join([f"`{text}` string", *[f"`{c}` {types[c]}" for c in keep], f"`{column}` {MATCHES}"])
            out = map_arrow(out, [text, *keep, column], run, schema)
        return out.drop(text), column

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """The documents that hold no benchmark item, with their columns."""
        marked, column = self.mark(docs, benchmark)
        return marked.filter(F.size(column) == 0).select(*docs.columns)


@register("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, each with its best window."""
    marked, column = Decontaminator().mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", F.explode(column).alias("m")).select("doc_id", "m.*")
