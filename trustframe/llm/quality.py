"""Quality rules with adaptive thresholds (operator 1).

Each document gets its counts in one pass.  Four signals (symbols and repeated words per 1000
words, repeated lines per 1000 lines, 100 x mean word length) go into quantile sketches per
language and source.  A sketch is a histogram over buckets of 6 leading bits (relative error
under 1/32): merging sketches is adding counts, so it does not depend on the order of tasks, a
re-run after a lost executor gives the same thresholds, and a source with a third of all rows is
summed inside each task.  A cell with fewer than ``min_rows`` documents takes the merged sketch
of its language, and that one, when small, the merged sketch of all.

The limits are fences beyond the quartiles: ``spread`` times their distance, from the lower end of
the lower quartile's bucket and the upper end of the upper quartile's, with no slack besides; a
quarter of a cell can be junk before they give way.  The sketches hold the documents that pass the
base rule.  Every document may have one symbol, one repeated line and one repeated 3-word window
(6 words), the least that a text can have, so these are taken off the counts.  Repeated
words come by chance in long clean texts and not at all in short ones, so their fence is that of
the documents that have any.  Documents and limits are then joined and filtered.

Defined results: null text, or one without words, has zero counts and fails the base rule; null
language or source is a group of its own; repeated rows are rows of their own; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trustframe.llm import kernels as K
from trustframe.llm.common import cut, map_arrow, register, table

# The symbols that count, by contract.
SYMBOLS = "#*$%&|<>"
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS.encode())] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"]


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _line_counts(data, off, texts):
    """Lines with a word, and those equal to an earlier line of the same text."""
    nl = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], nl + 1]), kind="stable")
    doc = np.repeat(np.arange(texts), np.diff(np.searchsorted(nl, off)) + 1)
    # an end is the next newline of the same text, or the text's end
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.append(start[1:] - 1, off[-1])
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = off[doc[last] + 1]
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(K.SPACED[data], out=c[1:])
    keep = c[end] > c[start]
    start, end, doc = start[keep], end[keep], doc[keep]
    h = K.hashes(data, start, end)
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    dup = d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]
    return np.bincount(doc, minlength=texts), np.bincount(dup, minlength=texts)


def text_counts(column) -> list[np.ndarray]:
    """The counts of _COUNTS for each text of an Arrow string column."""
    data, off = K.flat(column)
    texts = len(off) - 1
    start, end, first = K.spans(data, off)
    n_words = np.diff(first)
    lines, dup = _line_counts(data, off, texts)
    g, ok = K.windows(K.hashes(data, start, end), first, 3)
    at = np.flatnonzero(ok)
    doc = np.repeat(np.arange(texts, dtype=np.uint64), n_words)[at]
    key = K.mix(g[at] + doc * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    covered = np.zeros(len(start) + 3, bool)
    for j in range(3):
        covered[at[order[1:][same]] + j] = True
        covered[at[order[:-1][same]] + j] = True
    return [n_words, _per_text(K.CHAR[data] & K.SPACED[data], off), _per_text(_SYM[data], off), dup,
            _per_text(covered[:len(start)], first), lines]


def _features(batch):
    for part in K.slices(batch, 1):
        yield [part.column(0), part.column(2), part.column(3), *map(K.i64, text_counts(part.column(1)))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts, one row per document."""
    return map_arrow(docs, ["doc_id", "text", "lang", "source"], _features,
                     "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def bucket(v: str) -> Column:
    """The lower end of the sketch bucket of a count: its six leading bits."""
    e = f"greatest(0, length(bin({v})) - 6)"
    return F.expr(f"shiftleft(shiftright({v}, {e}), {e})")


@dataclass
class AdaptiveQuality:
    """``score(docs)``: counts, signals, limits and the verdict of each document.

    spread: how many distances of the quartiles a signal may lie beyond them.
    """

    spread: int = 5
    min_rows: int = 30

    # integer signals
    SIGNALS = {
        "symbols": "1000 * greatest(n_symbols - 1, 0) div greatest(n_words, 1)",
        "dup_lines": "1000 * greatest(n_dup_lines - 1, 0) div greatest(n_text_lines, 1)",
        "repeats": "1000 * greatest(n_repeat_words - 6, 0) div greatest(n_words, 1)",
        "word_len": "100 * word_chars div greatest(n_words, 1)",
    }
    #: of this signal, only the documents that have any are sketched
    NONZERO = "repeats"
    BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

    def sketches(self, feats: DataFrame) -> DataFrame:
        """(lang, source, signal, b, n): the sketch of each cell as bucket counts."""
        pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.expr(x).alias("v")) for s, x in self.SIGNALS.items()])
        return (feats.filter(f"NOT ({self.BASE_FAILED})").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.signal", "p.v")
                .filter((F.col("v") > 0) | (F.col("signal") != self.NONZERO))
                .withColumn("b", bucket("v")).groupBy("lang", "source", "signal", "b").agg(F.count("*").alias("n")))

    @staticmethod
    def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
        """Merges the sketches of equal keys; their rows and quartiles (bucket's lower end)."""
        merged = sketch.groupBy(*keys, "signal", "b").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "signal")  # at most 32 buckets for each power of two
        upto = (merged.withColumn("cum", F.sum("n").over(w.orderBy("b"))).withColumn("rows", F.sum("n").over(w)))
        return upto.groupBy(*keys, "signal").agg(
            F.max("rows").alias("rows"),
            *[F.min(F.expr(f"CASE WHEN cum * 4 >= {q} * rows THEN b END")).alias(f"q{q}") for q in (1, 2, 3)])

    def limits(self, feats: DataFrame) -> DataFrame:
        """One row per (lang, source): the upper limit of each signal, and the lower of word length."""
        sketch, few = self.sketches(feats), F.col("rows") < self.min_rows
        width = "shiftleft(1L, greatest(0, length(bin(q3)) - 6))"
        val = F.struct("q1", F.expr(f"q3 + {width} - 1").alias("q3"))
        cell = self.quantiles(sketch, ["lang", "source"]).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("signal").alias("g"), F.when(~few, val).alias("c"))
        lang = self.quantiles(sketch, ["lang"]).select(F.col("lang").alias("ll"), F.col("signal").alias("gl"), F.when(~few, val).alias("cl"))
        every = self.quantiles(sketch, []).select(F.col("signal").alias("ga"), val.alias("ca"))  # one row per signal
        asked = feats.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, self.SIGNALS))).alias("signal"))
        both = (asked.join(cell, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("signal") == F.col("g")), "left")
                .join(lang, F.col("lang").eqNullSafe(F.col("ll")) & (F.col("signal") == F.col("gl")), "left")
                .join(F.broadcast(every), F.col("signal") == F.col("ga"), "left").withColumn("q", F.coalesce("c", "cl", "ca")))
        hi, lo = F.expr(f"q.q3 + {self.spread} * (q.q3 - q.q1)"), F.expr(f"q.q1 - {self.spread} * (q.q3 - q.q1)")
        none = lambda s: F.lit(None if s == "word_len" else 0).cast("long")  # noqa: E731  no document has any: none may
        return both.groupBy("lang", "source").agg(
            *[F.coalesce(F.max(F.when(F.col("signal") == s, hi)), none(s)).alias(f"max_{s}") for s in self.SIGNALS],
            F.max(F.when(F.col("signal") == "word_len", lo)).alias("min_word_len"))

    def score(self, docs: DataFrame) -> DataFrame:
        feats = cut(features(docs))
        limit = self.limits(feats)
        for c in ("lang", "source"):
            limit = limit.withColumnRenamed(c, f"_{c}")
        x = feats.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
        x = x.withColumn("base_failed", F.expr(self.BASE_FAILED))
        bad = [F.col(f"sig_{s}") > F.col(f"max_{s}") for s in self.SIGNALS] + [F.col("sig_word_len") < F.col("min_word_len")]
        x = x.withColumns({f"sig_{s}": F.expr(e) for s, e in self.SIGNALS.items()})
        failed = bad[0]
        for b in bad[1:]:
            failed = failed | b
        return x.withColumn("kept", ~F.col("base_failed") & ~failed).drop("_lang", "_source")

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents that pass, with their columns (of rows with one id, all if one passes)."""
        good = self.score(docs).filter("kept").select(F.col("doc_id").alias("_good_id")).distinct()
        return docs.join(good, docs["doc_id"].eqNullSafe(good["_good_id"]), "left_semi")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
grams AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM grams WHERE z IS NOT NULL),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lc AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT t.doc_id, lang, source, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(lc.n - lc.d, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(lc.n, 0)::BIGINT AS n_text_lines
      FROM t JOIN w USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN cover USING (doc_id)),
s AS (SELECT *, 1000 * greatest(n_symbols - 1, 0) // greatest(n_words, 1) AS symbols, 1000 * greatest(n_dup_lines - 1, 0) // greatest(n_text_lines, 1) AS dup_lines,
        1000 * greatest(n_repeat_words - 6, 0) // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_len,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_len']) AS signal, unnest([symbols, dup_lines, repeats, word_len]) AS v FROM s WHERE NOT base_failed),
b AS (SELECT lang, source, signal, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS b FROM v WHERE v > 0 OR signal <> 'repeats'),
q AS (SELECT lang, source, signal, grouping(lang, source) AS lvl, count(*) AS rows, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3
      FROM b GROUP BY GROUPING SETS ((signal, lang, source), (signal, lang), (signal))),
u AS (SELECT lang, source, signal, lvl, lvl = 3 OR rows >= 30 AS used, q1, q3 + (1::BIGINT << greatest(0, length(bin(q3)) - 6)) - 1 AS q3 FROM q),
p AS (SELECT k.lang, k.source, k.signal,
        CASE WHEN c.used THEN c.q1 WHEN l.used THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN c.used THEN c.q3 WHEN l.used THEN l.q3 ELSE a.q3 END AS q3
      FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_len']) AS signal FROM (SELECT DISTINCT lang, source FROM s)) k
        LEFT JOIN u c ON c.lvl = 0 AND c.signal = k.signal AND c.lang IS NOT DISTINCT FROM k.lang AND c.source IS NOT DISTINCT FROM k.source
        LEFT JOIN u l ON l.lvl = 1 AND l.signal = k.signal AND l.lang IS NOT DISTINCT FROM k.lang
        LEFT JOIN u a ON a.lvl = 3 AND a.signal = k.signal),
lim AS (SELECT lang, source, coalesce(max(hi) FILTER (signal = 'symbols'), 0) AS max_symbols, coalesce(max(hi) FILTER (signal = 'dup_lines'), 0) AS max_dup_lines,
        coalesce(max(hi) FILTER (signal = 'repeats'), 0) AS max_repeats, max(hi) FILTER (signal = 'word_len') AS max_word_len,
        max(q1 - 5 * (q3 - q1)) FILTER (signal = 'word_len') AS min_word_len
      FROM (SELECT *, q3 + 5 * (q3 - q1) AS hi FROM p) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  base_failed, NOT base_failed AND symbols <= max_symbols AND dup_lines <= max_dup_lines
    AND repeats <= max_repeats AND word_len <= max_word_len AND word_len >= min_word_len AS kept,
  max_symbols::BIGINT AS max_symbols, max_dup_lines::BIGINT AS max_dup_lines, max_repeats::BIGINT AS max_repeats,
  max_word_len::BIGINT AS max_word_len, min_word_len::BIGINT AS min_word_len
FROM s JOIN lim ON lim.lang IS NOT DISTINCT FROM s.lang AND lim.source IS NOT DISTINCT FROM s.source
"""


@register("op1_quality", OP1_SQL)
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over all documents, with the limits that each met."""
    return AdaptiveQuality().score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "max_symbols", "max_dup_lines", "max_repeats", "max_word_len", "min_word_len")
