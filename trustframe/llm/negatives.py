"""Hard-negative mining with anchor spanning-tree bounds (operator 13).

Anchors are dealt into blocks of about ``block`` by the signs of their first components, and each
block gets a minimum spanning tree.  Rows are dealt into chunks by the hash of their id, and every
block visits every chunk (the stated query set against all rows, in blocks).  In a chunk the tree is
walked from its root, where all rows are scored.  For a child the parent's score plus or minus
edge length times row norm bounds the score (Cauchy-Schwarz); only rows whose bounds overlap what
is asked for are scored again, and these have an exact score for the child's own children:

* positives: rows of the anchor's label whose upper bound reaches the fifth largest lower bound;
* negatives: rows of other labels whose bounds overlap a window [80 %, 100 %] of a positive's score
  and reach the fifth largest lower bound of those that lie inside for certain.

Each chunk gives its best few for each anchor (and positive), and the best of all chunks follow
from a top-k by key.  Bounds are widened for rounding, scores are exact integers.

Defined results: rows with a null id, label, vector or component, or a component that isn't finite,
take no part; a shorter vector is filled up with zeros; a vec_id that several rows have counts
once, by its smallest label, then vector; equal scores are ordered by vec_id; a positive
score below 0 has an empty window, and 0 takes negatives of score 0; an anchor without positives
or negatives has no result row; an empty table gives an empty result; extra columns are not read.
Vectors whose scores could leave the exact range of 2^50 raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trustframe.llm.common import cut, register, small_batches, table

EXACT = 2**50


def spanning_tree(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree over the rows: (nodes in the order they join, parent of each, length of its edge)."""
    n = len(z)
    square = (z * z).sum(1)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, link = np.full(n, np.inf), np.zeros(n, np.int64)
    near[0] = 0.0
    done = np.zeros(n, bool)
    for i in range(n):
        at = int(np.argmin(np.where(done, np.inf, near)))
        order[i], parent[at], edge[at] = at, link[at], near[at]
        done[at] = True
        far = square + square[at] - 2 * (z @ z[at])  # exact, as all parts are integers below 2^53
        closer = ~done & (far < near)
        near[closer], link[closer] = far[closer], at
    return order, parent, np.sqrt(edge)


def narrow(z: np.ndarray) -> np.ndarray:
    """The integers in the fewest bytes that hold them."""
    most = np.abs(z).max(initial=0)
    return z.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def best(key: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each key, by score and then smaller id."""
    order = np.lexsort((ident, -score, key))
    own = key[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


class Walk:
    """Bounds of the scores of a slice of rows at every node of a block's tree."""

    def __init__(self, z: np.ndarray, norm: np.ndarray, nodes: np.ndarray):
        self.z, self.norm, self.nodes = z, norm, nodes
        self.lo, self.hi = np.empty((len(nodes), len(z))), np.empty((len(nodes), len(z)))
        self.scored = 0

    def enter(self, node: int, parent: int, edge: float, root: bool) -> None:
        if root:
            self.lo[node] = self.hi[node] = self.z @ self.nodes[node]
            self.scored += len(self.z)
            return
        reach = self.norm * (edge * (1 + 1e-9)) + 1
        self.lo[node] = self.lo[parent] - reach
        self.hi[node] = self.hi[parent] + reach

    def rescore(self, node: int, rows: np.ndarray) -> np.ndarray:
        """Exact scores of the rows (places); kept for the children."""
        open_ = rows[self.lo[node, rows] != self.hi[node, rows]]
        if len(open_):
            s = self.z[open_] @ self.nodes[node]
            self.lo[node, open_] = self.hi[node, open_] = s
            self.scored += len(open_)
        return self.lo[node, rows]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


@dataclass
class HardNegatives:
    every: int = 100  # anchors are ids divisible by this
    positives: int = 5
    negatives: int = 5
    low: int = 80  # a negative's score lies between low % and high % of the positive's
    high: int = 100
    block: int = 512  # anchors of a tree
    chunk: int = 65536  # rows that visit a block together
    slice: int = 4096  # rows with bounds in memory at a time
    least_chunks: int = 48  # as many, where there are 256 rows for each

    def rows(self, table_: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
        """vec_id, label and integer vector z of the rows that take part, once each."""
        ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        good = table_.select("vec_id", "label", "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(ok)
        label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("long")
        z = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
        once = good.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
        return once.select("vec_id", "v.*").select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), z.alias("z"))

    def _blocks(self, anchors: DataFrame, count: int, width: int) -> DataFrame:
        """One row a block: ids, labels, vectors, positives' ids and scores, and the tree, all packed."""
        bits = max(0, min(width, 20, (2 * count // self.block).bit_length() - 1))
        sign = F.lit(0)
        for i in range(bits):
            sign = sign * 2 + (F.element_at("z", i + 1) >= 0).cast("int")
        celled = anchors.withColumn("cell", sign)
        parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / self.block).alias("parts")).withColumnRenamed("cell", "c")
        dealt = celled.join(parts, F.col("cell") == F.col("c")).withColumn("part", F.expr("pmod(xxhash64(vec_id), parts)")).drop("c", "parts")

        def pack(group: pa.Table) -> pa.Table:
            group = group.sort_by("vec_id").combine_chunks()
            z = group["z"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, width)
            order, parent, edge = spanning_tree(z.astype(np.float64))
            small = narrow(z)
            pos = [(np.array([p["positive_id"] for p in x or []], np.int64), np.array([p["positive_score"] for p in x or []], np.int64)) for x in group["pos"].to_pylist()]
            columns = {"ids": group["vec_id"].to_numpy(), "labels": group["label"].to_numpy(), "vectors": small, "order": order, "parent": parent, "edge": edge,
                       "n_pos": np.array([len(a) for a, _ in pos], np.int64), "pos_ids": np.concatenate([a for a, _ in pos]), "pos_scores": np.concatenate([b for _, b in pos])}
            return pa.table({"bytes": pa.array([small.dtype.itemsize], pa.int32()), **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in columns.items()}})

        return cut(dealt.select("cell", "part", "vec_id", "label", "z", "pos").groupBy("cell", "part").applyInArrow(
            pack, "bytes int, " + ", ".join(f"`{c}` binary" for c in _PACKED)))

    def _visit(self, rows: DataFrame, blocks: DataFrame, chunks: int, width: int, visit, schema: str) -> DataFrame:
        """Every block at every chunk: ``visit(block, ids, labels, z)`` yields record batches."""
        empty = [F.lit(None).cast("int").alias("bytes"), *[F.lit(None).cast("binary").alias(c) for c in _PACKED]]
        body = rows.select(F.expr(f"pmod(xxhash64(vec_id), {chunks})").cast("int").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "label", "z", *empty)
        heads = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"),
                              F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<bigint>").alias("z"), "bytes", *_PACKED)
        dealt = body.union(heads).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
        small_batches(rows.sparkSession)

        def run(batches):
            at, held, own = None, [], None
            for batch in batches:
                chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                    if a == b:
                        continue
                    if chunk[a] != at:
                        at, held, own = chunk[a], [], None
                    part = batch.slice(a, b - a)
                    if kind[a] == 0:
                        held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(len(part), width).astype(np.float64)))
                        continue
                    if not held and own is None:
                        continue  # a chunk without rows
                    if own is None:
                        own, held = [np.concatenate(x) for x in zip(*held)], []
                    for i in range(len(part)):
                        yield from visit(_Block(part, i, width), *own)

        return dealt.mapInArrow(run, schema)

    def _slices(self, block, z):
        norm = np.sqrt((z * z).sum(1)) * (1 + 1e-9)
        for i in range(0, len(z), self.slice):
            walk = Walk(z[i:i + self.slice], norm[i:i + self.slice], block.z)
            for j, node in enumerate(block.order.tolist()):
                walk.enter(node, int(block.parent[node]), float(block.edge[node]), j == 0)
                yield i, node, walk

    def _best_positives(self, block, ids, labels, z):
        out = [[], [], []]
        for i, node, walk in self._slices(block, z):
            part = slice(i, i + self.slice)
            same = np.flatnonzero((labels[part] == block.labels[node]) & (ids[part] != block.ids[node]))
            rows = same[walk.hi[node, same] >= kth(walk.lo[node, same], self.positives)]
            score = walk.rescore(node, rows)
            take = rows[score >= kth(score, self.positives)]
            out[0].append(np.full(len(take), node))
            out[1].append(ids[part][take])
            out[2].append(walk.lo[node, take].astype(np.int64))
        node, ident, score = map(np.concatenate, out)
        at = best(node, score, ident, self.positives)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.ids[node[at]], ident[at], score[at])], names=["anchor_id", "positive_id", "positive_score"])

    def _best_negatives(self, block, ids, labels, z):
        out = [[], [], []]
        for i, node, walk in self._slices(block, z):
            part = slice(i, i + self.slice)
            other = np.flatnonzero(labels[part] != block.labels[node])
            lo, hi = walk.lo[node, other], walk.hi[node, other]
            asked = np.zeros(len(other), bool)
            windows = [(p, self.low * s / 100, self.high * s / 100) for p, s in block.of(node)]
            for _, a, b in windows:
                inside = lo[(lo >= a) & (hi <= b)]
                asked |= (hi >= max(a - 1, kth(inside, self.negatives))) & (lo <= b + 1)
            rows = other[asked]
            score = walk.rescore(node, rows).astype(np.int64)
            for (p, s), place in zip(block.of(node), range(*block.places(node))):
                hit = np.flatnonzero((100 * score >= self.low * s) & (100 * score <= self.high * s))
                hit = hit[score[hit] >= kth(score[hit], self.negatives)]
                out[0].append(np.full(len(hit), place))
                out[1].append(ids[part][rows[hit]])
                out[2].append(score[hit])
        place, ident, score = map(np.concatenate, out) if out[0] else (np.zeros(0, np.int64),) * 3
        at = best(place, score, ident, self.negatives)
        place = place[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.owner[place], block.pos_ids[place], block.pos_scores[place], ident[at], score[at])],
                                         names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    def mine(self, rows: DataFrame) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as from ``rows``."""
        rows = cut(rows)
        most = F.max(F.coalesce(F.array_max(F.transform("z", lambda x: F.abs(x))), F.lit(0)))
        n, anchors, width, top = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % self.every == 0), F.max(F.size("z")), most).first()
        width = max(1, width or 0)
        if (top or 0) ** 2 * width * 4 >= EXACT:
            raise ValueError(f"components up to {top / 256:g} in {width} dimensions are beyond exact scores")
        rows = rows.withColumn("z", F.concat("z", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("z"))))
        chunks = max(1, -(-n // self.chunk), min(n // 256, self.least_chunks))
        picked = rows.filter(F.col("vec_id") % self.every == 0)
        none = F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>").alias("pos")
        found = self._visit(rows, self._blocks(picked.select("*", none), anchors, width), chunks, width, self._best_positives,
                            "anchor_id long, positive_id long, positive_score long")
        first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= self.positives).drop("r")
        own = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pos"))  # at most ``positives``
        asked = picked.join(own, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
        got = self._visit(rows, self._blocks(asked, anchors, width), chunks, width, self._best_negatives,
                          "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        return (got.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= self.negatives)
                .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


_PACKED = ["ids", "labels", "vectors", "order", "parent", "edge", "n_pos", "pos_ids", "pos_scores"]


class _Block:
    """A block of anchors, unpacked."""

    def __init__(self, batch, i: int, width: int):
        raw = {n: batch.column(5 + j)[i].as_py() for j, n in enumerate(["bytes", *_PACKED])}
        whole = {n: np.frombuffer(raw[n], np.int64) for n in ("ids", "labels", "order", "parent", "n_pos", "pos_ids", "pos_scores")}
        self.__dict__.update(whole)
        self.edge = np.frombuffer(raw["edge"], np.float64)
        self.z = np.frombuffer(raw["vectors"], f"i{raw['bytes']}").reshape(-1, width).astype(np.float64)
        self.start = np.concatenate([[0], np.cumsum(self.n_pos)])
        self.owner = np.repeat(self.ids, self.n_pos)

    def places(self, node: int) -> tuple[int, int]:
        return int(self.start[node]), int(self.start[node + 1])

    def of(self, node: int) -> list[tuple[int, int]]:
        a, b = self.places(node)
        return list(zip(self.pos_ids[a:b].tolist(), self.pos_scores[a:b].tolist()))


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.z, r.z)::BIGINT AS score
      FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@register("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    op = HardNegatives()
    return op.mine(op.rows(table(spark, sf_dir, "embeddings")))
