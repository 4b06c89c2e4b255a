"""Sharding by Karmarkar-Karp differencing (operator 2).

Equal texts are one indivisible item.  A task differences a bounded set of items: the two partial
partitions with the largest spread are combined, one in descending and the other in ascending
order, until one is left.  The tasks form a tree.  The few items that are large against a shard
are differenced at the root; what its partition lacks in each shard is shared out among the nodes
below as one more partial partition, which they difference with their own, smaller items, and so
on down to the leaves, where items are dealt by hash.  A node holds the items above a quarter of
its children's share, so about 4 x shards x fan at most, and a leaf about ``cell``, whatever the
input.  Only groups with more bytes than a shard's share are split (at most as many as there are
shards, so their list is bounded), as no law on bytes could hold otherwise; their pieces are dealt
by row and take about half a share.

Rows are known by a number, so that repeated rows stay apart.  A number that Spark gives depends on
how the files are split, which changes with the executors, so rows are numbered once and written
with their numbers; every step reads that table.

Defined results: null text has no bytes and null texts are one group, apart from the empty text;
repeated rows are rows of their own; equal sizes are ordered by key; one text larger than a share
makes its shard larger; an empty table gives an empty result; input columns named like the added
ones are kept, and the added ones get a trailing underscore.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trustframe.llm.common import cut, fresh, register, table

OVERHEAD = 16


def difference(units: list[list[tuple[int, int]]], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp over partial partitions.

    units: for each, its parts as (sum, part id), at most k; ids are 0, 1, ... over all units.
    Returns the k-way partition as (sum, ids of the parts in it), in descending order of sums.
    """
    n = 1 + max((p for u in units for _, p in u), default=-1)
    over = list(range(n))  # the part that a part was put together with
    spread = lambda u: u[0][0] - (u[-1][0] if len(u) == k else 0) if u else 0
    heap = []
    for i, u in enumerate(units):
        u = sorted(u, key=lambda x: (-x[0], x[1]))
        heap.append((-spread(u), i, u))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a's parts at places 0, 1, ...; b's at k-1, k-2, ...: the largest with the smallest
        free = k - len(a)
        new = list(a)
        for j, (size, part) in enumerate(b):
            if j < free:
                new.append((size, part))
            else:
                at = k - 1 - j
                mine = new[at]
                over[part] = mine[1]
                new[at] = (mine[0] + size, mine[1])
        new.sort(key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (-spread(new), serial, new))
        serial += 1
    if not heap:
        return []
    out = [(size, []) for size, _ in heap[0][2]]
    place = {part: i for i, (_, part) in enumerate(heap[0][2])}
    for p in range(n):
        path = []
        q = p
        while over[q] != q:
            path.append(q)
            q = over[q]
        for x in path:
            over[x] = q
        out[place[q]][1].append(p)
    return out


@dataclass
class Sharding:
    shards: int = 40
    cell: int = 8192  # items differenced in one leaf
    fan: int = 64  # nodes below a node
    rows_per_cell: int = 20000  # rows numbered in one task

    @staticmethod
    def rows(docs: DataFrame, rid: Column | None = None) -> DataFrame:
        """rid (a new number unless given), doc_id, size, text_crc32 and the group's key of every row."""
        text = F.coalesce(docs["text"], F.lit("")).cast("binary")
        return docs.select(
            (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.when(docs["text"].isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text))).alias("gkey"))

    def _items(self, rows: DataFrame) -> DataFrame:
        """The rows with their piece of the group; 0 but for groups above a shard's share."""
        total = rows.agg(F.sum("size")).first()[0] or 0
        share = max(1, total // self.shards)
        heavy = (rows.groupBy("gkey").agg(F.sum("size").alias("b"), F.max("size").alias("each"))
                 .filter(F.col("b") > share)  # fewer than there are shards
                 .select(F.col("gkey").alias("hkey"), F.expr(f"greatest(1, ceil(b / greatest(each, {share} div 2)))").alias("pieces")))
        return (rows.join(F.broadcast(heavy), F.col("gkey") == F.col("hkey"), "left")
                .withColumn("piece", F.expr("coalesce(pmod(xxhash64(rid), pieces), 0)").cast("long")).drop("hkey", "pieces"))

    def partition(self, rows: DataFrame) -> DataFrame:
        """(gkey, piece, shard): where each item goes."""
        k, fan = self.shards, self.fan
        items = cut(rows.groupBy("gkey", "piece").agg(F.sum("size").alias("size")))
        total, count = items.agg(F.sum("size"), F.count("*")).first()
        leaves = max(1, -(-count // self.cell))
        widths = [leaves]  # nodes of each level, the root first
        while widths[0] > 1:
            widths.insert(0, -(-widths[0] // fan))
        # an item belongs to the deepest level whose nodes' shares it is small against
        level = F.lit(0)
        for n in widths[1:]:
            level = level + (F.col("size") * (4 * k * n) <= F.lit(total)).cast("int")
        items = items.withColumn("leaf", F.expr(f"pmod(xxhash64(gkey, piece), {leaves})").cast("long")).withColumn("level", level)

        def node(key, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            """Differences a node's items with what the levels above left to it (part i: shard i)."""
            own = own.sort_values(["size", "gkey", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
            start = [0] * k
            for part, size in zip(held["shard"], held["size"]):
                start[part] = int(size)
            units = [[(x, i) for i, x in enumerate(start)]] + [[(int(x), k + i)] for i, x in enumerate(own["size"])]
            where, sums = [0] * len(own), [0] * k
            for size, ids in difference(units, k):
                shard = next(i for i in ids if i < k)
                sums[shard] = size
                for i in ids:
                    if i >= k:
                        where[i - k] = shard
            out = pd.DataFrame({"gkey": own["gkey"], "piece": own["piece"], "shard": pd.Series(where, dtype="int32"), "node": int(key[0]), "size": own["size"]})
            left = pd.DataFrame({"gkey": None, "piece": None, "shard": pd.Series(range(k), dtype="int32"), "node": int(key[0]), "size": [x - min(sums) for x in sums]})
            return pd.concat([out, left.astype({"gkey": object, "piece": object})], ignore_index=True)

        spark, placed = rows.sparkSession, None
        held = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("shard"), F.lit(0).cast("long").alias("size"))
        for i, width in enumerate(widths):
            below = fan ** (len(widths) - 1 - i)  # leaves under a node
            own = items.filter(F.col("level") == i).withColumn("node", F.expr(f"leaf div {below}"))
            done = cut(own.groupBy("node").cogroup(held.groupBy("node")).applyInPandas(node, "gkey binary, piece long, shard int, node long, size long"))
            put = done.filter("piece IS NOT NULL").select("gkey", "piece", "shard")
            placed = put if placed is None else placed.union(put)
            if i + 1 < len(widths):
                next_width = widths[i + 1]
                first, last = F.col("node") * fan, F.least((F.col("node") + 1) * fan, F.lit(next_width)) - 1
                held = (done.filter("piece IS NULL").withColumn("n", last - first + 1)
                        .select(F.explode(F.sequence(first, last)).alias("node"), "shard", F.expr("size div n").alias("size")))
        return placed

    def assign(self, rows: DataFrame) -> DataFrame:
        """The rows (as from ``rows``, checkpointed) with shard and slot, gapless from 0 in each shard.

        A shard's rows are numbered in cells dealt by hash: the cells' counts give the offsets."""
        items = self._items(rows)
        where = self.partition(items)
        cells = max(1, -(-rows.count() // (self.shards * self.rows_per_cell)))
        put = cut(items.join(where, ["gkey", "piece"]).withColumn("sub", F.expr(f"pmod(xxhash64(rid, 7), {cells})"))
                  .drop("gkey", "piece"))
        before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        offset = put.groupBy("shard", "sub").agg(F.count("*").alias("c")).select(
            "shard", "sub", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
        at = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("rid")) - 1
        return (put.withColumn("at", at).join(offset, ["shard", "sub"])
                .withColumn("slot", F.col("at") + F.col("offset")).drop("at", "offset", "sub"))

    def shard(self, docs: DataFrame) -> DataFrame:
        """The documents with all their columns, shard and slot."""
        rid, shard, slot = fresh(docs, "rid", "shard", "slot")
        held = cut(docs.withColumn(rid, F.monotonically_increasing_id()))
        put = self.assign(cut(self.rows(held, F.col(rid)))).select(F.col("rid").alias(rid), F.col("shard").alias(shard), F.col("slot").alias(slot))
        return held.join(put, rid).drop(rid)


@register("op2_karmarkar_karp")
def op2_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    op = Sharding(shards=40)
    put = op.assign(cut(op.rows(table(spark, sf_dir, "documents"))))
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
