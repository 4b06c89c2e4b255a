"""Out-of-fold fits whose work doesn't grow with rounds times rows.

A tree sees a row only through the bins of its features, so the rows of a training part that share all
bins are one *cell* with a count of each label, and a tree on the cells is the tree on the rows: boosting
has the cell's residuals times its counts, and a bootstrap draws Poisson(n) for a cell's n rows, which is
the sum of their n draws.  Rows are read to pack them, for the quantiles behind the bins, for the cells, a few times
for the logistic weights (Newton steps of all folds at once) and to be scored; the hundreds of rounds
run over the cells, a fold's boosting or some of its forest's trees in each task.

Trees are those of MLlib: at most 32 bins with thresholds halfway between values, best variance (Gini) gain, log loss
boosting whose first tree fits the labels, forests that choose among ceil(sqrt(features)) at each
node, sister leaves of one class merged.  ``out_of_fold_scores`` gives None where cells would be too many for a task
or labels aren't 0 and 1; the caller then fits on the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.session import checkpoint_dir

BINS = 32
#: values that stand for a feature's rows of one part and fold
POINTS = 1024
#: cells of a training part, all of which a task and the lookup of scores hold; bits of a cell's number; patterns of the yes-or-no features
MOST_CELLS, KEY_BITS, MOST_PATTERNS = 500_000, 62, 4096
BLOCK_ROWS, TREES_A_TASK, MOST_STEPS = 10_000, 25, 100


# ------------------------------------------------------------------ bins and cells

def cuts(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds, halfway between neighbours: all of them if few, else those nearest to equal shares of the rows."""
    u, at = np.unique(values, return_inverse=True)
    if len(u) <= bins:
        return (u[:-1] + u[1:]) / 2
    cum = np.cumsum(np.bincount(at, counts))
    want = cum[-1] / bins * np.arange(1, bins)
    j = np.searchsorted(cum, want)
    j -= (j > 0) & (want - cum[np.maximum(j - 1, 0)] < cum[j] - want)
    j = np.unique(np.minimum(j, len(u) - 2))
    return (u[j] + u[j + 1]) / 2


def few_points(x: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts: all distinct ones, or the largest of each of ``points`` equal shares with the share's rows."""
    u, n = np.unique(x, return_counts=True)
    if len(u) <= points:
        return u, n
    cum = np.cumsum(n)
    j = np.unique(np.searchsorted(cum, cum[-1] / points * np.arange(1, points + 1)).clip(max=len(u) - 1))
    return u[j], np.diff(cum[j], prepend=0)


def cell_keys(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """The number of each row's cell: its bins as digits."""
    key = np.zeros(len(x), np.int64)
    for f, t in enumerate(thresholds):
        if len(t):
            key = key * (len(t) + 1) + np.searchsorted(t, x[:, f])
    return key


def cell_codes(key: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """The bins (features x cells) of cell numbers."""
    codes, rest = np.zeros((len(thresholds), len(key)), np.uint8), key
    for f in reversed(range(len(thresholds))):
        if len(thresholds[f]):
            rest, codes[f] = np.divmod(rest, len(thresholds[f]) + 1)
    return codes


# ------------------------------------------------------------------ trees

class Cells:
    """The bins of the cells, with those of yes-or-no features as patterns, so that one count serves them all."""

    def __init__(self, codes: np.ndarray, bins: list[int]):
        self.codes, self.features = codes, len(bins)
        self.wide = [(f, codes[f].astype(np.int64), b) for f, b in enumerate(bins) if b > 2]
        self.two, self.pattern, self.bits = [f for f, b in enumerate(bins) if b == 2], None, None
        if self.two:
            u, first, at = np.unique(np.packbits(codes[self.two], axis=0), axis=1, return_index=True, return_inverse=True)
            self.pattern, self.bits = np.ravel(at).astype(np.int64), codes[self.two][:, first].T.astype(float)
            if len(first) > MOST_PATTERNS:
                self.wide += [(f, codes[f].astype(np.int64), 2) for f in self.two]
                self.two, self.pattern = [], None

    def only(self, keep: np.ndarray) -> Cells:
        out = object.__new__(Cells)
        out.codes, out.features, out.two, out.bits = self.codes[:, keep], self.features, self.two, self.bits
        out.wide = [(f, c[keep], b) for f, c, b in self.wide]
        out.pattern = None if self.pattern is None else self.pattern[keep]
        return out


def best_splits(cells: Cells, node: np.ndarray, nodes: int, w: np.ndarray, s: np.ndarray, total_w: np.ndarray, total_s: np.ndarray):
    """(gain, last bin to the left) of every node and feature: the fall of the squared error of the sums ``s`` of ``w`` rows."""
    gain, cut = np.full((nodes, cells.features), -np.inf), np.zeros((nodes, cells.features), np.int16)
    base = total_s ** 2 / total_w

    def gains(left_w, left_s):
        right_w, right_s = total_w[:, None] - left_w, total_s[:, None] - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            g = left_s ** 2 / left_w + right_s ** 2 / right_w - base[:, None]
        return np.where((left_w > 0) & (right_w > 0), g, -np.inf)

    for f, code, bins in cells.wide:
        at = node * bins + code
        g = gains(*(np.bincount(at, v, nodes * bins).reshape(nodes, bins).cumsum(1)[:, :-1] for v in (w, s)))
        cut[:, f] = g.argmax(1)
        gain[:, f] = g.max(1)
    if cells.two:
        n = len(cells.bits)
        at = node * n + cells.pattern
        right = [np.bincount(at, v, nodes * n).reshape(nodes, n) @ cells.bits for v in (w, s)]
        gain[:, cells.two] = gains(total_w[:, None] - right[0], total_s[:, None] - right[1])
    return gain, cut


def grow(cells: Cells, w: np.ndarray, s: np.ndarray, depth: int, pick=None):
    """A tree level by level: (feature or -1, last bin to the left, left child (the right one follows), mean) of
    its nodes, and the mean at each cell's leaf.  ``pick`` gives the features (nodes x features) that nodes choose from."""
    feature, cut, left, value = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([s.sum() / w.sum()])]
    out, at, node, ids, made = np.full(len(w), value[0][0]), None, np.zeros(len(w), np.int64), np.array([0]), 1
    for _ in range(depth):
        total_w, total_s = np.bincount(node, w, len(ids)), np.bincount(node, s, len(ids))
        gain, bin_ = best_splits(cells, node, len(ids), w, s, total_w, total_s)
        if pick is not None:
            gain[~pick(len(ids))] = -np.inf
        f = gain.argmax(1)
        rows = np.arange(len(ids))
        split = gain[rows, f] > 1e-13 * total_s ** 2 / total_w
        if not split.any():
            break
        if not split.all():
            keep = split[node]
            cells, w, s, node = cells.only(keep), w[keep], s[keep], node[keep]
            at = np.flatnonzero(keep) if at is None else at[keep]
        rank = np.cumsum(split) - 1
        level = [np.concatenate(x) for x in (feature, cut, left)]
        level[0][ids[split]], level[1][ids[split]], level[2][ids[split]] = f[split], bin_[rows, f][split], made + 2 * rank[split]
        node = 2 * rank[node] + (cells.codes[f[node], np.arange(len(node))] > bin_[rows, f][node])
        ids = made + np.arange(2 * int(split.sum()))
        made += len(ids)
        value.append(np.bincount(node, s, len(ids)) / np.bincount(node, w, len(ids)))
        feature, cut, left = [level[0], np.full(len(ids), -1)], [level[1], np.zeros(len(ids), int)], [level[2], np.zeros(len(ids), int)]
        if at is None:
            out = value[-1][node]
        else:
            out[at] = value[-1][node]
    return (*(np.concatenate(x).astype(np.int32) for x in (feature, cut, left)), np.concatenate(value)), out


def merged(tree):
    """The tree with sister leaves of one class as one leaf, from the bottom up."""
    feature, cut, left, value = tree[0].copy(), *tree[1:]
    for i in range(len(feature) - 1, -1, -1):
        if feature[i] >= 0:
            a, b = left[i], left[i] + 1
            if feature[a] < 0 and feature[b] < 0 and (value[a] > 0.5) == (value[b] > 0.5):
                feature[i] = -1
    return feature, cut, left, value


def at_leaves(tree, codes: np.ndarray) -> np.ndarray:
    """The value of each cell's leaf."""
    feature, cut, left, value = tree
    node, cols = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    while (inner := feature[node] >= 0).any():
        f = feature[node]
        node = np.where(inner, left[node] + (codes[f, cols] > cut[node]), node)
    return value[node]


def boosted(cells: Cells, n0: np.ndarray, n1: np.ndarray, rounds: int, depth: int, rate: float) -> list:
    """Trees whose values add up to the margin: the first fits the labels -1 and 1, each other one the residuals of the log loss."""
    w, s, margin, trees = n0 + n1, n1 - n0, np.zeros(len(n0)), []
    for i in range(rounds):
        tree, fitted = grow(cells, w, s, depth)
        step = rate if i else 1.0
        trees.append((*tree[:3], tree[3] * step))
        margin += fitted * step
        with np.errstate(over="ignore"):
            s = n1 * (4.0 / (1.0 + np.exp(2.0 * margin))) - n0 * (4.0 / (1.0 + np.exp(-2.0 * margin)))
    return trees


def forest(cells: Cells, n0: np.ndarray, n1: np.ndarray, which: range, trees: int, depth: int, seed: int) -> list:
    """The trees ``which`` of a forest of ``trees``: each has draws of its own, whichever task grows it."""
    m, out = cells.features, []
    some = m if trees == 1 else math.ceil(math.sqrt(m))
    for t in which:
        rng = np.random.default_rng([seed, t])
        w0, w1 = rng.poisson(n0).astype(float), rng.poisson(n1).astype(float)
        drawn = w0 + w1 > 0
        if not drawn.any():  # nothing drawn: no vote
            out.append((np.array([-1], np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32), np.array([0.5])))
            continue

        def pick(nodes, rng=rng):
            return rng.random((nodes, m)).argsort(1).argsort(1) < some

        part = cells if drawn.all() else cells.only(drawn)
        out.append(merged(grow(part, (w0 + w1)[drawn], w1[drawn], depth, pick)[0]))
    return out


# ------------------------------------------------------------------ passes over the rows

def _blocks(batches):
    """(fold, label, features) of the packed rows of a part."""
    for batch in batches:
        for n, fold, label, x, size in zip(*(c.to_pylist() for c in batch.columns)):
            yield (np.frombuffer(fold, np.int64), np.frombuffer(label), np.frombuffer(pa.decompress(x, size, "lz4"), np.float64).reshape(n, -1))


def _batch(schema: str, rows: list):
    types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    names, kinds = zip(*(c.strip().split() for c in schema.split(",")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=list(names))


_PACKED = "n long, fold binary, label binary, x binary, size long"


def packed(table: DataFrame, fold: str) -> DataFrame:
    """The rows that have a fold, ten thousand in one, written once: reading them costs little."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = np.ascontiguousarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).tobytes()
                yield _batch(_PACKED, [(part.num_rows, part.column(0).to_numpy(zero_copy_only=False).tobytes(),
                                        part.column(1).to_numpy(zero_copy_only=False).tobytes(), pa.compress(x, "lz4", asbytes=True), len(x))])

    rows = table.filter(F.col(fold).isNotNull()).select(F.col(fold).cast("long"), F.col("label").cast("double"), vector_to_array("features"))
    checkpoint_dir(table.sparkSession)
    return rows.mapInArrow(run, _PACKED).checkpoint(eager=True)


_FACTS = "fold long, feature int, n long, ones double, bad_x long, bad_y long, mean double, m2 double, x binary, c binary"


def facts(blocks: DataFrame) -> list:
    """Of each part, fold and feature: rows, rows of label 1, values or labels that aren't allowed, mean, squared deviations, few points."""
    def run(batches):
        kept = list(_blocks(batches))
        if not kept:
            return
        fold, label, x = (np.concatenate(c) for c in zip(*kept))
        del kept
        for k in np.unique(fold):
            mine = fold == k
            y, rows = label[mine], []
            for f in range(x.shape[1]):
                v = x[mine, f]
                fine = v[np.isfinite(v)]
                u, c = few_points(fine) if len(fine) else (fine, fine)
                mean = fine.sum() / max(1, len(fine))
                rows.append((int(k), f, len(v), float((y == 1).sum()), len(v) - len(fine), int(((y != 0) & (y != 1)).sum()), float(mean),
                             float(((fine - mean) ** 2).sum()), u.tobytes(), c.astype(np.int64).tobytes()))
            yield _batch(_FACTS, rows)

    return blocks.mapInArrow(run, _FACTS).collect()  # parts x folds x features, of at most POINTS points


def spread(found: list) -> tuple[float, float, float]:
    """(rows, mean, squared deviations) of parts together."""
    n = sum(r["n"] for r in found)
    mean = sum(r["n"] * r["mean"] for r in found) / n
    return n, mean, sum(r["m2"] + r["n"] * (r["mean"] - mean) ** 2 for r in found)


def counted_cells(blocks: DataFrame, thresholds: list[list[np.ndarray]]) -> DataFrame:
    """(k, key, n0, n1): the cells of each training part k by label, with the cells of the rows held out (of no count)."""
    schema = "k int, key long, n0 long, n1 long"

    def run(batches):
        kept = [(fold, label, [cell_keys(x, t) for t in thresholds]) for fold, label, x in _blocks(batches)]
        if not kept:
            return
        fold, label = (np.concatenate([b[i] for b in kept]) for i in range(2))
        for k in range(len(thresholds)):
            u, at = np.unique(np.concatenate([b[2][k] for b in kept]), return_inverse=True)
            n = [np.bincount(at, (fold != k) & (label == y), len(u)).astype(np.int64) for y in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u), *map(pa.array, n)], names=["k", "key", "n0", "n1"])

    cells = blocks.mapInArrow(run, schema).groupBy("k", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return cells.checkpoint(eager=True)


def fitted_trees(cells: DataFrame, thresholds: list[list[np.ndarray]], algorithms: list[str], fits) -> dict:
    """The trees of each (algorithm, training part), a boosting or some trees of a forest in each task."""
    folds, schema = len(thresholds), "algorithm string, k int, tree int, feature binary, cut binary, left binary, value binary"
    boosts = "BoostedTrees" in algorithms
    chunks = boosts + (-(-fits.trees // TREES_A_TASK) if "RandomForest" in algorithms else 0)

    def run(batches):
        got = pa.Table.from_batches(list(batches))
        if not got.num_rows:
            return
        k, chunk = got["k"][0].as_py(), got["chunk"][0].as_py()
        key, n0, n1 = (got[c].to_numpy() for c in ("key", "n0", "n1"))
        order = np.argsort(key)
        n0, n1 = n0[order].astype(float), n1[order].astype(float)
        made = Cells(cell_codes(key[order], thresholds[k]), [len(t) + 1 for t in thresholds[k]])
        if boosts and chunk == 0:
            name, first, trees = "BoostedTrees", 0, boosted(made, n0, n1, fits.rounds, fits.depth, fits.rate)
        else:
            first = (chunk - boosts) * TREES_A_TASK
            name, trees = "RandomForest", forest(made, n0, n1, range(first, min(first + TREES_A_TASK, fits.trees)), fits.trees, fits.forest_depth, fits.seed)
        yield _batch(schema, [(name, k, first + i, *(a.tobytes() for a in t)) for i, t in enumerate(trees)])

    # boosting, the longest, comes first
    jobs = cells.filter("n0 + n1 > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    jobs = jobs.repartitionById(chunks * folds, (F.col("chunk") * folds + F.col("k")).cast("int"))
    out = {}
    for r in sorted(jobs.mapInArrow(run, schema).collect(), key=lambda r: r["tree"]):  # folds x trees, of a few dozen nodes
        out.setdefault((r["algorithm"], r["k"]), []).append((*(np.frombuffer(r[c], np.int32) for c in ("feature", "cut", "left")), np.frombuffer(r["value"])))
    return out


def cell_scores(cells: DataFrame, thresholds: list[list[np.ndarray]], trees: dict, algorithms: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each training part, its cells' numbers in order and their sums over the trees, one column an algorithm."""
    def run(batches):
        for batch in batches:
            ks, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = np.zeros((len(key), len(algorithms)))
            for k in np.unique(ks):
                mine = ks == k
                codes = cell_codes(key[mine], thresholds[k])
                out[mine] = np.column_stack([sum(at_leaves(t, codes) for t in trees[a, int(k)]) for a in algorithms])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(out[:, i]) for i in range(len(algorithms))]],
                                             names=["k", "key", *[f"s{i}" for i in range(len(algorithms))]])

    got = cells.select("k", "key").mapInArrow(run, "k int, key long" + "".join(f", s{i} double" for i in range(len(algorithms)))).toArrow()
    ks, key, *sums = (c.to_numpy() for c in got.columns)  # at most MOST_CELLS a part
    out = []
    for k in range(len(thresholds)):
        order = np.flatnonzero(ks == k)
        order = order[np.argsort(key[order])]
        out.append((key[order], np.column_stack([s[order] for s in sums])))
    return out


def logistic(blocks: DataFrame, found: list, folds: int, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(center, scale, weights) such that a row's margin without fold k is ((x - center) / scale, 1) @ weights[k]: the
    least summed log loss and half the squared weights of the features standardised over the training part.

    Newton steps of all folds in one pass over the rows, a step halved where the loss didn't fall."""
    m = 1 + max(r["feature"] for r in found)
    every = [[r for r in found if r["feature"] == f] for f in range(m)]
    whole = [spread(rs) for rs in every]
    center = np.array([mean for _, mean, _ in whole])
    scale = np.array([math.sqrt(d / max(1, n - 1)) for n, _, d in whole])
    scale = np.where(scale > 0, scale, 1.0)
    weights, ridge, loss, step, rows = np.zeros((folds, m + 1)), np.zeros((folds, m)), [math.inf] * folds, [None] * folds, []
    open_ = []
    for k in range(folds):
        parts = [spread([r for r in rs if r["fold"] != k]) for rs in every]
        # null where a feature is the same in all rows: it has no weight
        ridge[k] = [(math.sqrt(d / max(1, n - 1)) / s) ** 2 for (n, _, d), s in zip(parts, scale)]
        n, ones = parts[0][0], sum(r["ones"] for r in every[0] if r["fold"] != k)
        if 0 < ones < n:
            open_.append(k)
        else:  # one label: as sure as can be
            weights[k, m] = math.inf if ones else -math.inf
    schema = "k int, loss double, g binary, h binary"

    def run(batches, weights, open_):
        sums = {k: [0.0, np.zeros(m + 1), np.zeros((m + 1, m + 1))] for k in open_}
        for fold, y, x in _blocks(batches):
            z = np.column_stack([(x - center) / scale, np.ones(len(x))])
            margins = z @ weights[open_].T
            for i, k in enumerate(open_):
                use = fold != k
                a, t, e = z[use], margins[use, i], y[use]
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-t))
                sums[k][0] += float((np.logaddexp(0.0, t) - e * t).sum())
                sums[k][1] += a.T @ (p - e)
                sums[k][2] += a.T @ (a * (p * (1.0 - p))[:, None])
        yield _batch(schema, [(k, s[0], s[1].tobytes(), s[2].tobytes()) for k, s in sums.items()])

    for _ in range(MOST_STEPS):
        if not open_:
            break
        now = blocks.mapInArrow(lambda b, w=weights.copy(), o=list(open_): run(b, w, o), schema).collect()  # parts x folds
        for k in list(open_):
            mine = [r for r in now if r["k"] == k]
            used = np.r_[ridge[k] > 0, True]
            pen = np.r_[ridge[k], 0.0]
            here = sum(r["loss"] for r in mine) + 0.5 * float(pen @ weights[k] ** 2)
            if here > loss[k] * (1 + 1e-12):
                step[k] = step[k] / 2
                weights[k] += step[k]
                if np.abs(step[k]).max() < 1e-12:
                    open_.remove(k)
                continue
            g = sum(np.frombuffer(r["g"]) for r in mine) + pen * weights[k]
            h = sum(np.frombuffer(r["h"]).reshape(m + 1, m + 1) for r in mine) + np.diag(pen)
            move = np.zeros(m + 1)
            move[used] = np.linalg.solve(h[np.ix_(used, used)], g[used])
            loss[k], step[k] = here, move
            weights[k] -= move
            if g @ move <= tol * here:
                open_.remove(k)
    return center, scale, weights


# ------------------------------------------------------------------ scores

def out_of_fold_scores(table: DataFrame, fold: str, folds: int, algorithms: list[str], fits) -> DataFrame | None:
    """The rows of the folds with model_id, y_pred and score, or None where the rows' cells can't be counted."""
    width = table.select(F.size(vector_to_array("features")).alias("m")).first()
    if width is None or not 0 < width["m"] <= KEY_BITS:
        return None
    blocks = packed(table, fold)
    found = facts(blocks)
    if bad := sum(r["bad_x"] for r in found):
        raise ValueError(f"features must not be NaN or infinite, but {bad} values are")
    for k in range(folds):
        if not any(r["fold"] != k for r in found):
            raise ValueError(f"no rows to fit on without fold {k}")
    if any(r["bad_y"] for r in found):
        return None
    on_cells, lookup, thresholds = [a for a in algorithms if a != "LogisticRegression"], None, None
    if on_cells:
        points = {}
        for r in found:
            points.setdefault((r["feature"], r["fold"]), []).append((np.frombuffer(r["x"]), np.frombuffer(r["c"], np.int64)))
        thresholds = [[cuts(*(np.concatenate(c) for c in zip(*(p for (g, j), ps in points.items() if g == f and j != k for p in ps))),
                            min(BINS, sum(r["n"] for r in found if r["feature"] == 0 and r["fold"] != k))) for f in range(width["m"])] for k in range(folds)]
        if any(math.prod(len(t) + 1 for t in ts) > 2 ** KEY_BITS for ts in thresholds):
            return None
        cells = counted_cells(blocks, thresholds)
        if cells.groupBy("k").count().agg(F.max("count")).first()[0] > MOST_CELLS:
            return None
        lookup = cell_scores(cells, thresholds, fitted_trees(cells, thresholds, on_cells, fits), on_cells)
    line = logistic(blocks, found, folds) if "LogisticRegression" in algorithms else None
    trees, kept = fits.trees, [c for c in table.columns if c not in ("label", "features")]

    def run(batches):
        for batch in batches:
            own, x = batch.column(len(kept)).to_numpy(zero_copy_only=False), batch.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, -1)
            y, score = np.zeros((2, batch.num_rows, len(algorithms)))
            for k in np.unique(own):
                mine = own == k
                sums = {}
                if lookup is not None:
                    key, s = lookup[k]
                    s = s[np.searchsorted(key, cell_keys(x[mine], thresholds[k]))]
                    sums = {a: s[:, i] for i, a in enumerate(on_cells)}
                for i, a in enumerate(algorithms):
                    if a == "RandomForest":
                        score[mine, i], y[mine, i] = sums[a] / trees, sums[a] > trees / 2
                        continue
                    # the margin of boosted trees is half the log odds
                    margin = 2.0 * sums[a] if a == "BoostedTrees" else (x[mine] - line[0]) / line[1] @ line[2][k, :-1] + line[2][k, -1]
                    with np.errstate(over="ignore"):
                        score[mine, i], y[mine, i] = 1.0 / (1.0 + np.exp(-margin)), margin > 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *(pa.array(v[:, i]) for v in (y, score) for i in range(len(algorithms)))], names=names)

    names = kept + [f"_{v}{i}" for v in "ys" for i in range(len(algorithms))]
    schema = T.StructType([table.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in names[len(kept):]])
    rows = table.filter(F.col(fold).isin(list(range(folds)))).select(*kept, F.col(fold).cast("long").alias("_fold"), vector_to_array("features").alias("_x"))
    out = rows.mapInArrow(run, schema)
    models = F.array(*[F.struct(F.lit(a).alias("model_id"), F.col(f"_y{i}").alias("y_pred"), F.col(f"_s{i}").alias("score")) for i, a in enumerate(algorithms)])
    return out.select(*kept, F.explode(models).alias("_m")).select("_m.model_id", *kept, "_m.y_pred", "_m.score")
