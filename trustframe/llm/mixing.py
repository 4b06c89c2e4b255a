"""Mixing sources to target weights by Poisson replication (operator 5), in DataFrame functions only.

A source's repetition rate is the bytes wanted of it over the bytes it has.  A document's uniform
number comes from a hash of the seed and its doc_id; the count is the number of steps of the
source's Poisson distribution function that lie at or below it, so the mean is the rate, the
count depends on nothing but the id and the rate, and a re-run task draws the same.  Each copy is
a row; rows are then sorted by a hash of seed, id and copy, over the whole output.

Rates are one row per source, summed map-side, so one source with a third of all rows is no more
work than many small ones.  The distribution function of a large rate is split: counts of
independent Poisson draws with parts of the rate, at most ``part`` each, add up to one draw.

Defined results: null source is a source of its own; null or empty text counts as one byte, so
no source has none; sources without a target weight, or with 0, are left out; target sources
that have no document can't be given and the others share in proportion; a null doc_id draws by
the hash of null; rows that repeat a doc_id draw the same count; an empty table gives an empty
result; added columns that clash get a trailing underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import cut, fresh, register, table


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, written with colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


@dataclass
class PoissonMix:
    weights: dict | None = None  # target share by source; None: bytes ** power
    power: float = 0.7
    budget: int | None = None  # bytes of the mixture; None: as many as there are
    seed: int = 17
    part: float = 8.0  # the largest rate drawn at once
    steps: int = 60  # of its distribution function; beyond, the chance is under 1e-26

    def rates(self, docs: DataFrame) -> DataFrame:
        """(source, rate): one row per source that has a weight."""
        size = F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
        have = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
        if self.weights is None:
            have = have.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(self.power)))
        else:
            named = F.create_map(*[F.lit(x) for s, w in self.weights.items() if s is not None for x in (s, float(w))]) if any(
                s is not None for s in self.weights) else F.lit(None).cast("map<string,double>")
            null = F.lit(float(self.weights.get(None, 0.0)))
            have = have.withColumn("weight", F.coalesce(F.when(F.col("source").isNull(), null).otherwise(F.try_element_at(named, F.col("source"))), F.lit(0.0)))
        have = have.filter("weight > 0")
        total = have.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b")).first()  # two numbers
        budget = F.lit(self.budget if self.budget is not None else total["b"]).cast("long")
        return have.select("source", (F.col("weight") / F.lit(total["w"]) * budget / F.col("bytes")).alias("rate"))

    def _steps(self, rate: Column) -> Column:
        """The Poisson distribution function at 0, 1, ...: exp(-rate) (1 + rate + rate^2 / 2! ...)."""
        start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

        def step(acc, i):
            p = acc["p"] * rate / i
            return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

        return F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(self.steps)), start, step, lambda a: a["all"])

    def counts(self, docs: DataFrame) -> tuple[DataFrame, str, str]:
        """The documents with their source's rate and their number of copies, and these columns' names."""
        src, rate, n, cdf, parts, u = fresh(docs, "source_key", "rate", "n_copies", "cdf", "parts", "u")
        # a written table, so that the planner knows its size and sends it to the documents if small
        rates = cut(self.rates(docs)).select(
            F.col("source").alias(src), F.col("rate").alias(rate), F.ceil(F.col("rate") / self.part).cast("int").alias(parts))
        rates = rates.withColumn(cdf, self._steps(F.col(rate) / F.col(parts)))
        one = lambda i: F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(self.seed), docs["doc_id"], i)))
        # the usual source draws once; the further parts of a large rate add to it
        first = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
        more = F.aggregate(F.sequence(F.lit(2), F.col(parts)), F.lit(0), lambda s, i: s + one(i))
        both = (docs.join(rates, docs["source"].eqNullSafe(F.col(src)))
                .withColumn(u, uniform(F.lit(self.seed), docs["doc_id"], F.lit(1)))
                .withColumn(n, first + F.when(F.col(parts) > 1, more).otherwise(0)))
        return both.drop(src, cdf, parts, u), rate, n

    def mix(self, docs: DataFrame, report: bool = False) -> DataFrame:
        """The mixture in its shuffled order, with the columns of documents; with ``report`` also
        rate, n_copies, copy (from 1) and shuffle_key."""
        both, rate, n = self.counts(docs)
        copy, key = fresh(both, "copy", "shuffle_key")
        both = both.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        both = both.withColumn(key, F.md5(F.concat_ws(":", F.lit(f"order {self.seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy)).cast("binary")))
        both = both.orderBy(key)
        return both if report else both.select(*docs.columns)


OP5_SQL = r"""
WITH b AS (SELECT source, sum(greatest(strlen(coalesce(text, '')), 1)) AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(pow(bytes::DOUBLE, 0.7)) AS w, sum(bytes) AS total FROM b),
r AS (SELECT source, pow(bytes::DOUBLE, 0.7) / w * total / bytes AS rate FROM b, t),
p AS (SELECT source, rate, ceil(rate / 8.0)::INT AS parts, rate / ceil(rate / 8.0) AS each FROM r),
terms AS (SELECT source, k, exp(-each) * list_product(list_transform(range(1, k + 1), lambda i: each / i)) AS x FROM p, (SELECT unnest(range(0, 61)) AS k)),
cdf AS (SELECT source, k, sum(x) OVER (PARTITION BY source ORDER BY k) AS c FROM (SELECT source, k, coalesce(x, (SELECT exp(-each) FROM p p2 WHERE p2.source IS NOT DISTINCT FROM terms.source)) AS x FROM terms)),
u AS (SELECT doc_id, d.source, rate, i, ('0x' || substr(md5('17:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d JOIN p ON p.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(1, parts + 1)) AS i)),
n AS (SELECT u.doc_id, u.source, any_value(u.rate) AS rate, count(*)::BIGINT AS n_copies FROM u JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u GROUP BY u.doc_id, u.source)
SELECT n.doc_id, d.lang, n.source, floor(rate * 1000000 + 0.5) / 1000000 AS rate, n_copies, copy::BIGINT AS copy, md5('order 17:' || n.doc_id || ':' || copy) AS shuffle_key, md5(coalesce(d.text, '')) AS text_md5
FROM n JOIN documents d USING (doc_id), LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy)
"""


@register("op5_poisson_mix", OP5_SQL)
def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to shares of bytes ** 0.7, each copy a row, in shuffled order."""
    mixed = PoissonMix(power=0.7).mix(table(spark, sf_dir, "documents"), report=True)
    return mixed.select("doc_id", "lang", "source", (F.floor(F.col("rate") * 1000000 + 0.5) / 1000000).alias("rate"), F.col("n_copies").cast("long").alias("n_copies"),
                        F.col("copy").cast("long").alias("copy"), "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
