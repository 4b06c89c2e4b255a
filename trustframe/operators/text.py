"""Corpus BLEU and ROUGE over (prediction, reference) text pairs.

N-gram overlap is counted inside the row that holds both texts of a pair (an
Arrow UDF, linear in the text); corpus sums are one aggregation, so no text
is shuffled.  Whole texts are processed (no prefixes).  ROUGE-L needs an
LCS per pair, done by an Arrow UDF with a row-vectorised DP.

Tokenisation (re-aimed, documented in the README):
* BLEU: punctuation split from words, whitespace split, case kept; or the
  13a tokenisation (``bleu_tokens_13a``), with exponential smoothing on request.
* ROUGE: lower case, runs of characters outside [a-z0-9] are separators;
  stemmed on request (Porter's published algorithm, tokens of more than
  three letters).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.expr import lit_d
from trustframe.functions.stem import stem_tokens

# The 13a tokenisation's replacements, in order.
TEXT_13A = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
SPLIT_13A = [(r"([{-~\[-` -&(-+:-@/])", " {1} "), (r"([^0-9])([.,])", "{1} {2} "), (r"([.,])([^0-9])", " {1} {2}"),
             (r"([0-9])(-)", "{1} {2} ")]


def bleu_tokens(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"([^\p{L}\p{N}\s_])", " $1 ")
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda x: x != "")


def bleu_tokens_13a(c: Column) -> Column:
    for old, new in TEXT_13A:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, new in SPLIT_13A:
        c = F.regexp_replace(c, pattern, new.replace("{1}", "$1").replace("{2}", "$2"))
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def rouge_tokens_stemmed(c: Column) -> Column:
    return stem_tokens(rouge_tokens(c))


def rouge_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda x: x != "")


def _coded(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The token arrays of each pair as numbers of the batch's distinct tokens (null: no tokens)."""
    both = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False)
    at, ends = 0, []
    for x in (a, b):
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        ends.append(at + np.append(0, np.cumsum(sizes)))
        at = int(ends[-1][-1])
    for i in range(len(a)):
        yield codes[ends[0][i]:ends[0][i + 1]], codes[ends[1][i]:ends[1][i + 1]]


def _clipped(a: list, b: list, n: int) -> int:
    """N-grams that two token lists share, each as often as in the one that has fewer."""
    grams = [Counter(zip(*[x[i:] for i in range(n)])) for x in (list(a), list(b))]
    return sum((grams[0] & grams[1]).values())


def overlap_udf(max_n: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def matches(p: pa.Array, r: pa.Array) -> pa.Array:
        pairs = ((x.tolist(), y.tolist()) for x, y in _coded(p, r))
        return pa.array([[_clipped(x, y, n) for n in range(1, max_n + 1)] for x, y in pairs], pa.list_(pa.int64()))

    return matches


def overlap_table(pairs: DataFrame, keys: list[str], max_n: int, tokenizer) -> DataFrame:
    """Per (pair, n): clipped matches, prediction n-grams, reference n-grams; both texts of a pair
    stand in one row, so they are counted there and nothing but the totals moves."""
    t = pairs.select(*keys, tokenizer(F.col("prediction")).alias("pt"), tokenizer(F.col("reference")).alias("rt"))
    t = t.select(*keys, F.size("pt").alias("lp"), F.size("rt").alias("lr"), overlap_udf(max_n)("pt", "rt").alias("_m"))
    t = t.select(*keys, "lp", "lr", F.posexplode("_m").alias("_i", "matches"))
    n = F.col("_i") + 1
    return t.select(*keys, n.alias("n"), "lp", "lr", "matches",
                    F.greatest(F.col("lp") - n + 1, F.lit(0)).alias("pred_ngrams"),
                    F.greatest(F.col("lr") - n + 1, F.lit(0)).alias("ref_ngrams"))


def corpus_bleu_smoothed(pairs: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """A19 as the standard scorer has it: 13a tokens and exponential smoothing, by which the j-th order
    without a match counts 1/2^j matches; 0 if nothing matches or an order has no n-grams."""
    group = group or []
    o = overlap_table(pairs, keys, 4, bleu_tokens_13a)
    at = lambda c, i: F.coalesce(F.sum(F.when(F.col("n") == i, F.col(c))), F.lit(0))
    g = o.groupBy(*group).agg(*[at("matches", i).alias(f"_m{i}") for i in range(1, 5)],
                              *[at("pred_ngrams", i).alias(f"_t{i}") for i in range(1, 5)],
                              at("lp", 1).alias("sys_len"), at("lr", 1).alias("ref_len"))
    logs, zeros = lit_d(0.0), F.lit(0)
    for i in range(1, 5):
        zeros = zeros + F.when(F.col(f"_m{i}") == 0, 1).otherwise(0)
        logs = logs + F.log(F.when(F.col(f"_m{i}") > 0, F.col(f"_m{i}").cast("double")).otherwise(F.pow(lit_d(2.0), -zeros)) / F.col(f"_t{i}"))
    bp = F.when(F.col("sys_len") >= F.col("ref_len"), lit_d(1.0)).when(
        F.col("sys_len") > 0, F.exp(1 - F.col("ref_len") / F.col("sys_len"))).otherwise(lit_d(0.0))
    some = (F.col("_t4") > 0) & (F.col("_m1") > 0)
    return g.select(*group, F.when(some, 100.0 * bp * F.exp(logs / 4.0)).otherwise(lit_d(0.0)).alias("bleu_score"),
                    bp.alias("brevity_penalty"), "sys_len", "ref_len")


def corpus_bleu(pairs: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """Corpus BLEU (0–100) per group of pairs: clipped n-gram precisions
    for n = 1..4, geometric mean, brevity penalty exp(1 − r/c) when c < r."""
    group = group or []
    o = overlap_table(pairs, keys, 4, bleu_tokens)
    per_n = o.groupBy(*group, "n").agg(F.sum("matches").alias("m"), F.sum("pred_ngrams").alias("t"))
    lens = o.filter(F.col("n") == 1).groupBy(*group).agg(F.sum("lp").alias("c"), F.sum("lr").alias("r"))
    logp = per_n.groupBy(*group).agg(
        F.sum(F.when((F.col("m") > 0) & (F.col("t") > 0), F.log(F.col("m") / F.col("t")))).alias("_slog"),
        F.min(F.when(F.col("t") > 0, F.col("m"))).alias("_minm"), F.count(F.lit(1)).alias("_nn"))
    j = logp.join(lens, group) if group else logp.withColumn("_k", F.lit(1)).join(lens.withColumn("_k", F.lit(1)), "_k")
    bp = F.when(F.col("c") >= F.col("r"), lit_d(1.0)).when(F.col("c") > 0,
                                                            F.exp(1 - F.col("r") / F.col("c"))).otherwise(lit_d(0.0))
    bleu = F.when((F.col("_minm") > 0) & (F.col("_nn") == 4), 100.0 * bp * F.exp(F.col("_slog") / 4.0)) \
            .otherwise(lit_d(0.0))
    return j.select(*group, bleu.alias("bleu_score"), bp.alias("brevity_penalty"),
                    F.col("c").alias("sys_len"), F.col("r").alias("ref_len"))


def rouge_n(pairs: DataFrame, keys: list[str], tokens=rouge_tokens) -> DataFrame:
    """A20 (1 and 2): per-pair F-measure, then the mean."""
    o = overlap_table(pairs, keys, 2, tokens)
    p = F.when(F.col("pred_ngrams") > 0, F.col("matches") / F.col("pred_ngrams")).otherwise(lit_d(0.0))
    r = F.when(F.col("ref_ngrams") > 0, F.col("matches") / F.col("ref_ngrams")).otherwise(lit_d(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(lit_d(0.0))
    per = o.select(*keys, "n", f.alias("f"))
    return per.groupBy().pivot("n", [1, 2]).agg(F.avg("f")).select(
        F.col("1").alias("rouge1"), F.col("2").alias("rouge2"))


def _lcs_len(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(b) > len(a):
        a, b = b, a
    prev = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        cand = np.maximum(prev[1:], np.where(b == x, prev[:-1] + 1, 0))
        new = np.empty_like(prev)
        new[0] = 0
        new[1:] = np.maximum.accumulate(cand)
        prev = new
    return int(prev[-1])


@F.arrow_udf(T.LongType())
def lcs_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_lcs_len(x, y) for x, y in _coded(a, b)], pa.int64())


def rouge_l(pairs: DataFrame, keys: list[str], tokens=rouge_tokens) -> DataFrame:
    """A20 (L): LCS-based F-measure per pair (Arrow UDF), then the mean."""
    t = pairs.select(*keys, tokens(F.col("prediction")).alias("pt"),
                     tokens(F.col("reference")).alias("rt"))
    t = t.withColumn("lcs", lcs_udf("pt", "rt"))
    p = F.when(F.size("pt") > 0, F.col("lcs") / F.size("pt")).otherwise(lit_d(0.0))
    r = F.when(F.size("rt") > 0, F.col("lcs") / F.size("rt")).otherwise(lit_d(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(lit_d(0.0))
    return t.agg(F.avg(f).alias("rougeL"))
