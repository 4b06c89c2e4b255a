"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts (operator 4).

``LineIndex`` keeps two tables in the shared folder: the exact number of documents of every line
key, and, for each shard of the key space, a cuckoo filter of the keys that have reached
``min_docs``.  ``insert`` and ``delete`` add and subtract a batch of documents' counts; the keys
that cross the limit either way are inserted into, or deleted from, their shard's filter (a full
one is built anew from the exact table), so deleting documents undoes inserting them.

``apply`` sends each distinct line key of a document to its shard, where it meets the filter as
the first row of a sorted partition and is streamed past it.  Shards are salted: a line that a
third of all documents share is dealt over ``salts`` tasks.  What passes is looked up in the
exact table, so a false hit of a filter changes nothing.  The keeper of a line is the largest
doc_id among the documents given to ``apply``.

Defined results: null or empty text is one empty line, which is never dropped; rows with
equal doc_ids count as one document, and rows without one as one more; a null doc_id never keeps a
line; the index has counts and no ids, so ``insert`` is for documents that it doesn't hold yet and
``delete`` for those that it does, each batch with all rows of its ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import cut, folder, map_arrow, register, table
from trustframe.llm.cuckoo import Cuckoo, as_words

_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """16-byte key of a line, None if it has too few code points."""
    line = line.strip(_SPACE)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id): each distinct line key of each row."""

    def run(batch):
        keys, rows = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = {line_key(x, min_chars) for x in text.split("\n")} - {None} if text else ()
            keys += own
            rows += [i] * len(own)
        yield [pa.array(keys, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))]

    return map_arrow(docs, ["doc_id", "text"], run, "key binary, doc_id long")


def _shard(shards: int):
    """A key's shard, from its first four bytes (the filters use the last eight)."""
    return F.expr(f"cast(pmod(conv(hex(substring(key, 1, 4)), 16, 10), {shards}) as int)")


@dataclass(frozen=True)
class LineIndex:
    counts: DataFrame  # key, n
    filters: DataFrame  # shard, filter
    shards: int
    min_chars: int = 20
    min_docs: int = 3
    keys_per_shard: int = 32768
    salts: int = 8

    @classmethod
    def build(cls, docs: DataFrame, **options) -> LineIndex:
        self = cls(None, None, 1, **options)
        self = replace(self, counts=self._stored(self._count(docs)))
        hot = self.counts.filter(F.col("n") >= self.min_docs)
        self = replace(self, shards=max(1, -(-hot.count() // self.keys_per_shard)))
        return replace(self, filters=self._filters_of(hot))

    def _stored(self, df: DataFrame) -> DataFrame:
        path = folder(df.sparkSession, "line-index")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _count(self, docs: DataFrame) -> DataFrame:
        return line_keys(docs, self.min_chars).distinct().groupBy("key").agg(F.count("*").alias("n"))

    def _filters_of(self, hot: DataFrame) -> DataFrame:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = as_words(sorted(pdf["key"]))
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [Cuckoo.of(keys).dump()]})

        return self._stored(hot.withColumn("shard", _shard(self.shards)).groupBy("shard").applyInPandas(build, "shard int, filter binary"))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = self._count(docs).select("key", F.lit(0).cast("long").alias("n"), (F.col("n") * sign).alias("d"))
        both = cut(self.counts.select("key", "n", F.lit(0).cast("long").alias("d")).union(delta)
                   .groupBy("key").agg(F.sum("n").alias("old"), F.sum(F.col("n") + F.col("d")).alias("n")))
        new = replace(self, counts=self._stored(both.filter("n > 0").select("key", "n")))
        was, now = F.col("old") >= self.min_docs, F.col("n") >= self.min_docs
        turned = both.filter(was != now).select("key", _shard(self.shards).alias("shard"), now.alias("add"))

        def update(key, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            f = Cuckoo.load(filters["filter"].iloc[0]) if len(filters) else Cuckoo.for_keys(len(keys))
            done = True
            if len(keys):
                keys = keys.sort_values("key")
                done = f.update(as_words(keys["key"]), keys["add"].to_numpy())
            return pd.DataFrame({"shard": [key[0]], "filter": [f.dump() if done else None]})

        moved = cut(self.filters.groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(update, "shard int, filter binary"))
        full = moved.filter("filter IS NULL").select("shard")
        again = new.counts.filter(F.col("n") >= self.min_docs).withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi")
        return replace(new, filters=self._stored(moved.filter("filter IS NOT NULL").union(self._filters_of(again.drop("shard")))))

    def probe(self, keys: DataFrame) -> DataFrame:
        """The rows (key, doc_id) that pass their shard's filter."""
        salt = F.expr(f"cast(pmod(xxhash64(doc_id), {self.salts}) as int)")
        rows = keys.select(_shard(self.shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("kind"), F.col("key").alias("body"), "doc_id")
        heads = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"), F.lit(0).alias("kind"),
                                    F.col("filter").alias("body"), F.lit(None).cast("long").alias("doc_id"))
        dealt = heads.union(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def run(batches):
            at, held = None, None
            for batch in batches:
                shard, salt, kind = (batch.column(i).to_numpy() for i in range(3))
                place = shard.astype(np.int64) * 4096 + salt
                cuts = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                    if a == b:
                        continue
                    if kind[a] == 0:
                        at, held = place[a], Cuckoo.load(batch.column(3)[a].as_py())
                    elif at == place[a]:
                        own = batch.slice(a, b - a)
                        hit = pa.array(held.contains(as_words(own.column(3).to_pylist())))
                        yield pa.RecordBatch.from_arrays([own.column(3).filter(hit), own.column(4).filter(hit)], names=["key", "doc_id"])

        return dealt.mapInArrow(run, "key binary, doc_id long")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): the line keys that each document loses."""
        hot = self.counts.filter(F.col("n") >= self.min_docs).select("key")
        held = cut(self.probe(line_keys(docs, self.min_chars)).join(hot, "key"))
        keeper = held.groupBy("key").agg(F.max("doc_id").alias("keeper"))
        lost = held.join(keeper, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) of each row."""
        min_chars = self.min_chars
        lost = self.drops(docs).withColumnRenamed("doc_id", "_id")

        def run(batch):
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                total, gone, kept = [], [], []
                for text, keys in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = (text or "").split("\n")
                    stay = [x for x in own if line_key(x, min_chars) not in keys] if keys and (keys := set(keys)) else own
                    total.append(len(own))
                    gone.append(len(own) - len(stay))
                    kept.append("\n".join(stay))
                yield [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]

        both = docs.select("doc_id", "text").join(lost, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        return map_arrow(both, ["doc_id", "text", "keys"], run, "doc_id long, n_lines long, n_dropped long, kept_text string")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
l AS (SELECT rid, doc_id, i, x, lower_ascii, length(lower_ascii) AS n FROM (
        SELECT rid, doc_id, i, x, translate(trim(x, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (SELECT rid, doc_id, unnest(own) AS x, generate_subscripts(own, 1) AS i FROM d))),
k AS (SELECT lower_ascii, max(doc_id) AS keeper FROM l WHERE n >= 20 GROUP BY lower_ascii HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 3),
m AS (SELECT l.*, k.lower_ascii IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keeper AS gone FROM l LEFT JOIN k ON n >= 20 AND k.lower_ascii = l.lower_ascii)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


@register("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more in three documents or more stay in the last one only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = LineIndex.build(docs, min_chars=20, min_docs=3).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
