"""Substring dedup by a relative Lempel-Ziv parse against indexed reference blocks (operator 8).

A document is parsed into factors copied from text that comes earlier (a smaller doc_id, or the
same document further up) and literals in between; factors of ``window`` words or more are
duplicate spans.

The reference index holds every document and is cut into blocks by the hash of an anchor: of the
6-word grams of a window the one with the smallest hash.  Equal windows have equal anchors at
equal places, so all the references that a window can have are in the one block that its anchor
leads to, and asking that block is asking every block.  A document sends each of its anchors,
with the 64-bit hashes of the windows around it, to the anchor's block; there the rows come sorted by
anchor, document and place, so the first that holds a window is its reference and each later one
gets a run of windows copied from it.  Runs of one reference that follow one another are joined
to greedy factors; windows that cross the boundary of two factors have been asked for themselves,
so a span that straddles a boundary isn't lost.

An anchor that many different windows share (a frequent phrase with other words around it) would
give its block to one task.  A first pass counts the windows of each anchor on a sixty-fourth of them,
picked by hash, and the windows of frequent anchors go each to a block of its own hash: equal windows
still meet, so the count decides where a window is asked and never the result.

A task first parses a slice of documents against itself, and sends only what was new in the
slice; a passage that a third of all documents share costs one row for each slice.  A block
streams its rows and holds the windows of one anchor; an anchor with more than ``held`` of them
is resolved by a grouped aggregation instead.

Defined results: null text has no words; a null doc_id comes before all others; rows that repeat
a doc_id and a text are one document, with another text they are ordered by its hash; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import kernels as K
from trustframe.llm.common import cut, map_arrow, register, table

GRAM = 6
_LEAST = -(1 << 63)
_RUN = np.dtype([("n", "<i4"), ("ref", "<i8"), ("at", "<i4")])
_ROWS = "h long, kind byte, d long, th long, pos int, body binary"


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the first smallest of x[i : i + width]."""
    at, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        span += step
    return at


def packed(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column whose values are runs of the rows' bytes, from each cut to the next."""
    raw = np.ascontiguousarray(rows).view(np.uint8).ravel()
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    off = (np.append(cuts, len(rows)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def runs_of(row: np.ndarray, start: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a new run begins: another row, a gap, or another reference."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def firsts(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first of each (group, key), and for each place that of its first."""
    order = np.lexsort((key, group))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1])
    one, src = order[new], np.empty(len(order), np.int64)
    src[order] = one[np.cumsum(new) - 1]
    return one, src


def parsed(batch, width: int):
    """For slices of documents: the documents' columns, the words' hashes, each document's first word, each
    word's document, and the places and hashes of whole windows (a repeated row has none)."""
    for part in K.slices(batch, 2, 2 * K.SLICE_BYTES):
        part = part.take(pa.compute.sort_indices(part.select(["d", "th"]), sort_keys=[("d", "ascending"), ("th", "ascending")]))
        data, off = K.flat(part.column(2))
        start, end, first = K.spans(data, off)
        words = K.hashes(data, start, end)
        doc = np.repeat(np.arange(part.num_rows), np.diff(first))
        d, th = (part.column(i).to_numpy() for i in (0, 1))
        # a repeated row (same id and text) is left to the first
        again = np.zeros(part.num_rows, bool)
        again[1:] = (d[1:] == d[:-1]) & (th[1:] == th[:-1])
        g, ok = K.windows(words, first, width)
        ok &= ~again[doc]
        at = np.flatnonzero(ok)
        if len(at):
            yield d, th, words, first, doc, at, g[at]


@dataclass
class SubstringDedup:
    """``hot`` windows make an anchor frequent; ``most`` anchors at most are treated so, the most frequent,
    so any other has at most ``hot`` windows or one in ``most`` of all.  Neither changes a result."""

    window: int = 20
    held: int = 1 << 20
    hot: int = 1 << 16
    most: int = 1 << 16
    sampled: int = 64

    def _frequent(self, docs: DataFrame) -> np.ndarray:
        """The frequent anchors, at most ``most`` numbers, sorted."""
        width, one_of = self.window, np.uint64(self.sampled)

        def run(batch):
            for _, _, words, first, _, at, g in parsed(batch, width):
                _, one = np.unique(g, return_index=True)
                one = one[K.mix(g[one]) % one_of == 0]
                if len(one):
                    grams, _ = K.windows(words, first, GRAM)
                    h, n = np.unique(grams[least_at(grams, width - GRAM + 1)[at[one]]], return_counts=True)
                    yield [K.i64(h), pa.array(n, pa.int64())]

        counts = map_arrow(docs, ["d", "th", "text"], run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        top = counts.filter(F.col("n") * self.sampled >= self.hot).orderBy(F.col("n").desc(), "h").limit(self.most)
        return np.sort(np.array([r["h"] for r in top.select("h").collect()], np.int64))

    def _sent(self, docs: DataFrame) -> DataFrame:
        """Rows for the blocks: anchors with windows that follow one another from ``pos`` on, as their
        hashes (kind 0), and runs found in a slice (1)."""
        width, frequent = self.window, self._frequent(docs).view(np.uint64)

        def run(batch):
            for d, th, words, first, doc, at, g in parsed(batch, width):
                place = at - first[doc[at]]
                _, one, inv = np.unique(g, return_index=True, return_inverse=True)
                src = one[inv]
                old = np.flatnonzero(src != np.arange(len(g)))
                if len(old):
                    ref, ref_at = d[doc[at[src[old]]]], place[src[old]]
                    cuts = runs_of(doc[at[old]], place[old], ref, ref_at)
                    body = np.empty(len(cuts), _RUN)
                    body["n"], body["ref"], body["at"] = np.diff(np.append(cuts, len(old))), ref[cuts], ref_at[cuts]
                    who, s = doc[at[old]][cuts], place[old][cuts]
                    spread = K.mix(s.astype(np.uint64) + d[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    yield [K.i64(spread), pa.array(np.ones(len(cuts), np.int8)), pa.array(d[who]), pa.array(th[who]),
                           pa.array(s.astype(np.int32)), packed(body, np.arange(len(cuts)))]
                grams, _ = K.windows(words, first, GRAM)
                anchor = least_at(grams, width - GRAM + 1)[at[one_sorted := np.sort(one)]]
                own, block = at[one_sorted], grams[anchor]
                lone = np.isin(block, frequent)
                block = np.where(lone, K.mix(block ^ K.mix(g[one_sorted])), block)
                cuts = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1] + 1) | lone[1:]))
                who = doc[own[cuts]]
                yield [K.i64(block[cuts]), pa.array(np.zeros(len(cuts), np.int8)), pa.array(d[who]), pa.array(th[who]),
                       pa.array((own[cuts] - first[who]).astype(np.int32)), packed(g[one_sorted].astype("<u8"), cuts)]

        return map_arrow(docs, ["d", "th", "text"], run, _ROWS)

    def _resolved(self, sent: DataFrame) -> DataFrame:
        """Runs (kind 1), and the windows of anchors too large to hold (kind 2, h and body their key)."""
        held = self.held

        def run(batches):
            last, seen, over = None, None, False  # the anchor that goes on, its windows, whether they were too many
            for batch in batches:
                kind = batch.column(1).to_numpy()
                if (kind == 1).any():
                    yield batch.filter(pa.array(kind == 1))
                    batch = batch.filter(pa.array(kind == 0))
                if not batch.num_rows:
                    continue
                h = batch.column(0).to_numpy()
                goes_on = last is not None and h[0] == last
                if not goes_on:
                    seen, over = None, False
                same = np.zeros(len(h) + 1, bool)
                same[1:-1] = h[1:] == h[:-1]
                same[0] = goes_on
                last = h[-1]
                keep = same[:-1] | same[1:]
                keep[-1] = True  # it may go on in the next batch
                rows = batch.filter(pa.array(keep))
                h, d, th, pos = (rows.column(i).to_numpy() for i in (0, 2, 3, 4))
                raw, off = K.flat(rows.column(5))
                key = raw.view("<u8")
                row = np.repeat(np.arange(len(h)), np.diff(off) // 8)
                start = pos[row].astype(np.int64) + np.arange(len(key)) - off[row] // 8
                group = np.append(0, np.cumsum(h[1:] != h[:-1]))[row]
                who, text = d[row], th[row]
                base = 0
                if goes_on and seen is not None:
                    base = len(seen[0])
                    key, who, text, start = (np.concatenate(x) for x in zip(seen, (key, who, text, start)))
                    group, row = np.concatenate([np.zeros(base, np.int64), group]), np.concatenate([np.full(base, -1), row])
                one, src = firsts(group, key)
                other = (who[src] != who) | (text[src] != text) | (start[src] != start)  # not the same row once more
                old = np.flatnonzero(other & (np.arange(len(src)) >= base))
                if len(old):
                    cuts = runs_of(row[old], start[old], who[src[old]], start[src[old]])
                    body = np.empty(len(cuts), _RUN)
                    body["n"], body["ref"], body["at"] = np.diff(np.append(cuts, len(old))), who[src[old]][cuts], start[src[old]][cuts]
                    o = old[cuts]
                    yield out(np.zeros(len(o), np.int64), 1, who[o], text[o], start[o], packed(body, np.arange(len(cuts))))
                lone = h[-1] == h[0]
                if over:  # goes on from the batch before
                    new = np.sort(one[group[one] == 0])
                    yield many(h[0], *(x[new] for x in (key, who, text, start)))
                    if lone:
                        seen = None
                        continue
                new = np.sort(one[group[one] == group[-1]])
                seen, over = tuple(x[new] for x in (key, who, text, start)), len(new) > held
                if over:
                    yield many(last, *seen)
                    seen = None

        def many(h, key, who, text, start):
            return out(np.full(len(key), h), 2, who, text, start, packed(key, np.arange(len(key))))

        def out(h, kind, d, th, pos, body):
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(np.full(len(h), kind, np.int8)), pa.array(d), pa.array(th),
                                               pa.array(pos.astype(np.int32)), body], names=["h", "kind", "d", "th", "pos", "body"])

        return sent.repartition("h").sortWithinPartitions("h", "d", "th", "pos").mapInArrow(run, _ROWS)

    def runs(self, docs: DataFrame) -> DataFrame:
        """(d, th, runs): for each document its copied runs as (start, windows, reference, its start)."""
        found = cut(self._resolved(self._sent(docs)))
        large = found.filter("kind = 2").select("h", "body", "d", "th", "pos")
        first = large.groupBy("h", "body").agg(F.min(F.struct("d", "th", "pos")).alias("r"))
        rest = (large.join(first, ["h", "body"]).filter("struct(d, th, pos) != r")
                .select("d", "th", "pos", F.lit(1).alias("n"), F.col("r.d").alias("ref"), F.col("r.pos").alias("at")))
        usual = map_arrow(found.filter("kind = 1"), ["d", "th", "pos", "body"], _unpacked, "d long, th long, pos int, n int, ref long, at int")
        return usual.union(rest).groupBy("d", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "n", "ref", "at"))).alias("runs"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_text, factors) of each row; a factor is (start, n_words,
        ref_doc_id, ref_start) in words."""
        width = self.window
        docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).alias("d"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
        found = self.runs(docs).select(F.col("d").alias("rd"), F.col("th").alias("rth"), "runs")
        both = docs.join(found, (F.col("d") == F.col("rd")) & (F.col("th") == F.col("rth")), "left")
        both = both.select("doc_id", "text", F.transform("runs", lambda r: r["pos"]).alias("s"), F.transform("runs", lambda r: r["n"]).alias("n"),
                           F.transform("runs", lambda r: r["ref"]).alias("r"), F.transform("runs", lambda r: r["at"]).alias("a"))

        def run(batch):
            for part in K.slices(batch, 1):
                data, off = K.flat(part.column(1))
                start, end, first = K.spans(data, off)
                raw = data.tobytes()
                total, gone, kept, factors = [], [], [], []
                for i in range(part.num_rows):
                    a, b = int(first[i]), int(first[i + 1])
                    total.append(b - a)
                    stay, own = np.ones(b - a, bool), []
                    if part.column(2)[i].is_valid:
                        s, n, r, at = (part.column(c)[i].values.to_numpy() for c in (2, 3, 4, 5))
                        for x, c, ref, y in zip(s.tolist(), n.tolist(), r.tolist(), at.tolist()):
                            stay[x:x + c + width - 1] = False
                            # the factor goes on while its reference does
                            if own and own[-1][2] == ref and own[-1][0] + own[-1][1] - width + 1 == x and own[-1][3] + own[-1][1] - width + 1 == y:
                                own[-1][1] += c
                            else:
                                own.append([x, c + width - 1, ref, y])
                    k = np.flatnonzero(stay) + a
                    gone.append(b - a - len(k))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(start[k].tolist(), end[k].tolist())]).decode("utf-8", "replace"))
                    factors.append([{"start": x, "n_words": n, "ref_doc_id": None if ref == _LEAST else ref, "ref_start": y} for x, n, ref, y in own])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())]))
                yield [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, kind)]

        return map_arrow(both, ["doc_id", "text", "s", "n", "r", "a"], run, "doc_id long, n_words long, n_removed long, kept_text string, "
                         "factors array<struct<start:int,n_words:int,ref_doc_id:long,ref_start:int>>")


def _unpacked(batch):
    raw, _ = K.flat(batch.column(3))
    b = np.frombuffer(raw.tobytes(), _RUN)
    yield [batch.column(0), batch.column(1), batch.column(2), pa.array(b["n"]), pa.array(b["ref"]), pa.array(b["at"])]


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(range(1, greatest(len(ws) - 18, 1))) AS i, ws FROM t),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT doc_id, i AS a FROM f WHERE k > 1),
x AS (SELECT p.doc_id, p.i, p.w, last_value(a IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS near FROM
        (SELECT t.doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t) p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.a = p.i),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (near IS NOT NULL AND i - near < 20) AS n_removed,
        string_agg(w, ' ' ORDER BY i) FILTER (near IS NULL OR i - near >= 20) AS kept FROM x GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)
"""


@register("op8_relative_lz", OP8_SQL)
def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that occur earlier."""
    out = SubstringDedup(window=20).dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
