"""Dataset insights (quality, outliers, correlations).

Scale notes
* Quartiles are exact, by radix selection, and never unpivot the table: doubles are read as 64-bit
  keys in their order, and four passes fix 16 bits of a rank's key each.  A pass counts, for all columns
  at once, the next 16 bits of the keys that begin as known so far; at most 65536 counts a
  rank leave a task, whatever the input, and no value does.  ``method='approx'`` stops after two passes.
* Moments are one wide aggregation; outliers are counted in one more pass (IQR and z-score).
* Distinct counts are one aggregation a column, each over a scan of that column alone.
* Pearson accumulates cross products of all columns in each task, in numpy over Arrow batches around
  the columns' means, with the counts of rows that both columns have; the plan has no expression a pair.
* Spearman groups columns by their null pattern.  For two patterns the rows complete in both are
  ranked once for all their columns: value counts, a distributed running sum, average ranks, and
  the same cross products over them.  Columns whose distinct values fit a checked size have their ranks
  sent to the tasks; the others are joined back in one equi-join on (column, value).
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.expr import count_if, lit_d, round_half
from trustframe.operators.health import numeric_columns
from trustframe.operators.splits import with_running_sum
from trustframe.session import checkpoint_dir


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def long_values(df: DataFrame, cols: list[str], keep_nulls: bool = False) -> DataFrame:
    """(column, col_ord, value) for the numeric cells (non-null unless asked)."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("col_ord"),
                             _q(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    lv = df.select(F.explode(arr).alias("_v")).select("_v.column", "_v.col_ord", "_v.value")
    return lv if keep_nulls else lv.filter(F.col("value").isNotNull())


#: distinct values (of all columns together) whose ranks are sent to the tasks
SENT = 1 << 20
_SIGN = np.uint64(1 << 63)


def _wide(df: DataFrame, cols: list[str], aggs: dict) -> list[dict]:
    """One wide aggregation: for each column its aggregates (``aggs``: name → f(Column, ordinal))."""
    if not cols:
        return []
    one = df.agg(*[f(_q(c).cast("double"), i).alias(f"{nm}_{i}") for i, c in enumerate(cols) for nm, f in aggs.items()]).first()
    return [{nm: one[f"{nm}_{i}"] for nm in aggs} for i in range(len(cols))]


def _real(v: Column) -> Column:
    """Numbers; NaN counts as missing."""
    return F.when(~F.isnan(v), v)


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's columns (doubles) as rows of a matrix; null is NaN."""
    return np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns])


def _keys(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the doubles (0.0 and -0.0 are equal)."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u & _SIGN, ~u, u | _SIGN)


def _value(key: int) -> float:
    u = np.uint64(key)
    return float((u & ~_SIGN if u & _SIGN else ~u).reshape(1).view(np.float64)[0])


def _radix_select(df: DataFrame, cols: list[str], asks: list[tuple[int, int]], levels: int) -> list[float]:
    """For each (column, rank): the value there (exact with four levels; its bucket's lower end with fewer)."""
    prefix, rank = [0] * len(asks), [r for _, r in asks]
    for level in range(levels):
        slots = sorted({(i, p) for (i, _), p in zip(asks, prefix)})

        def run(batches, slots=slots, level=level):
            counts = np.zeros((len(slots), 1 << 16), np.int64)
            for batch in batches:
                x, last = _matrix(batch), None
                for k, (i, p) in enumerate(slots):  # a column's slots follow one another
                    if i != last:
                        keys, last = _keys(x[i][~np.isnan(x[i])]), i
                        begins = keys >> np.uint64(64 - 16 * level) if level else None
                    key = keys[begins == np.uint64(p)] if level else keys
                    np.add.at(counts[k], ((key >> np.uint64(48 - 16 * level)) & np.uint64(0xFFFF)).astype(np.int64), 1)
            k, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[k, at])], names=["k", "at", "c"])

        got = (_numbers(df, cols).mapInArrow(run, "k int, at int, c long").groupBy("k", "at").agg(F.sum("c").alias("c"))
               .orderBy("k", "at").toPandas())  # at most 65536 rows a slot
        for a, (i, _) in enumerate(asks):
            own = got[got["k"] == slots.index((i, prefix[a]))]
            upto = own["c"].cumsum().to_numpy()
            hit = int(np.searchsorted(upto, rank[a], "right"))
            rank[a] -= int(upto[hit - 1]) if hit else 0
            prefix[a] = prefix[a] << 16 | int(own["at"].iloc[hit])
    return [_value(p << (64 - 16 * levels)) for p in prefix]


def column_quartiles(df: DataFrame, cols: list[str], method: str = "exact", qs: tuple = (0.25, 0.75)) -> list[dict]:
    """For each column: n, n_all, moments, and ``q`` (the quantiles ``qs``, linearly interpolated)."""
    at = _wide(df, cols, {
        "n": lambda v, i: F.count(_real(v)), "n_all": lambda v, i: F.count(F.lit(1)), "min_value": lambda v, i: F.min(v), "max_value": lambda v, i: F.max(v),
        "mean": lambda v, i: F.avg(v), "std": lambda v, i: F.stddev_samp(v)})
    asks = [(i, r) for i, a in enumerate(at) if a["n"] for q in qs for r in (math.floor(q * (a["n"] - 1)), math.ceil(q * (a["n"] - 1)))]
    found = iter(_radix_select(df, cols, asks, 4 if method == "exact" else 2) if asks else [])
    for a in at:
        a["q"] = [None] * len(qs)
        for j, q in enumerate(qs if a["n"] else ()):
            lo, hi = next(found), next(found)
            a["q"][j] = lo + (q * (a["n"] - 1) - math.floor(q * (a["n"] - 1))) * (hi - lo)
    return at


def quartiles(df: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """(column, col_ord, n, q1, q3) with linear interpolation; one row per numeric column with values."""
    rows = [(c, i, a["n"], *map(float, a["q"])) for i, (c, a) in enumerate(zip(cols, column_quartiles(df, cols, method))) if a["n"]]
    return df.sparkSession.createDataFrame(rows, "column string, col_ord int, n long, q1 double, q3 double")


_FENCED = ("column string, col_ord int, n long, n_all long, outliers long, lower_bound double, upper_bound double, "
           "min_value double, max_value double, mean double, std double")


def _outside(df: DataFrame, cols: list[str], at: list[dict], outside) -> DataFrame:
    """One row per column with its bounds (``lower_bound`` and ``upper_bound`` of ``at``), moments and the
    count of cells that ``outside(values, facts)`` marks (numpy), counted in one pass."""

    def run(batches):
        total = np.zeros(len(cols), np.int64)
        for batch in batches:
            total += [int(outside(v[~np.isnan(v)], a).sum()) if a["n"] else 0 for v, a in zip(_matrix(batch), at)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cols), dtype=np.int32)), pa.array(total)], names=["i", "c"])

    counts = {r["i"]: r["c"] for r in _numbers(df, cols).mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()} if cols else {}
    rows = [(c, i, a["n"], a["n_all"], counts.get(i, 0), *[None if a[k] is None else float(a[k]) for k in ("lower_bound", "upper_bound", "min_value", "max_value", "mean", "std")])
            for i, (c, a) in enumerate(zip(cols, at))]
    return df.sparkSession.createDataFrame(rows, _FENCED)


def _fenced(df: DataFrame, cols: list[str], method: str) -> DataFrame:
    """Per numeric column: IQR bounds, outlier count and moments."""
    at = column_quartiles(df, cols, method)
    for a in at:
        q1, q3 = a["q"]
        a["lower_bound"], a["upper_bound"] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None)
    return _outside(df, cols, at, lambda v, a: (v < a["lower_bound"]) | (v > a["upper_bound"]))


def fences(df: DataFrame, method: str = "exact") -> DataFrame:
    """The numeric columns' IQR bounds, outlier counts and moments (a row each), for ``data_quality`` and
    ``outliers_iqr`` of one table to share."""
    return _fenced(df, numeric_columns(df, df.columns), method)


def _distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """nd0, nd1, ...: distinct values of each column, each counted over that column alone."""
    each = [df.agg(F.count_distinct(_q(c)).alias("nd")).select(F.lit(i).alias("i"), "nd") for i, c in enumerate(cols)]
    return functools.reduce(DataFrame.unionByName, each).agg(*[F.max(F.when(F.col("i") == i, F.col("nd"))).alias(f"nd{i}") for i in range(len(cols))])


def data_quality(df: DataFrame, dataset_id: str = "dataset", method: str = "exact", fenced: DataFrame | None = None) -> DataFrame:
    """Completeness, validity, uniqueness, consistency, overall, status.  ``fenced``: the table's ``fences``, if known."""
    cols = df.columns
    num = numeric_columns(df, cols)
    base = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.count(_q(c)).alias(f"nn{i}") for i, c in enumerate(cols)])
    base = base.join(F.broadcast(_distinct_counts(df, cols)))  # one row each
    n = F.col("n").cast("double")
    total = n * len(cols)
    nonnull = sum((F.col(f"nn{i}") for i in range(len(cols))), F.lit(0))
    completeness = F.when(total > 0, nonnull / total * 100).otherwise(lit_d(0.0))
    uniq = sum((F.when(n > 0, F.col(f"nd{i}") / n * 100).otherwise(lit_d(0.0))
                for i in range(len(cols))), lit_d(0.0)) / max(1, len(cols))
    base = base.select(F.lit(dataset_id).alias("dataset_id"), "n",
                       completeness.alias("_comp"), F.least(uniq, lit_d(100.0)).alias("_uniq"),
                       (total - nonnull).cast("long").alias("missing_values"))
    if num:
        f = _fenced(df, num, method) if fenced is None else fenced
        # consistency over all rows; nulls and all-null columns count as inside
        cons = (f.select(F.lit(dataset_id).alias("dataset_id"), "outliers")
                 .groupBy("dataset_id").agg(F.sum("outliers").alias("_out_sum")))
        base = base.join(cons, "dataset_id", "left")
        n_num = len(num)
        consistency = F.when(F.col("n") > 0, (F.col("n") * n_num - F.col("_out_sum"))
                             / (F.col("n") * n_num) * 100).otherwise(lit_d(100.0))
    else:
        consistency = lit_d(100.0)
    base = base.withColumn("_cons", consistency)
    overall = (F.col("_comp") + 100.0 + F.col("_uniq") + F.col("_cons")) / 4
    return base.select(
        "dataset_id",
        round_half(F.col("_comp"), 1).alias("completeness"), lit_d(100.0).alias("validity"),
        round_half(F.col("_uniq"), 1).alias("uniqueness"),
        round_half(F.col("_cons"), 1).alias("consistency"),
        round_half(overall, 1).alias("overall_score"),
        F.col("n").alias("total_rows"), F.lit(len(cols)).alias("total_columns"), "missing_values",
        F.when(overall >= 80, F.lit("good")).when(overall >= 60, F.lit("warning"))
         .otherwise(F.lit("poor")).alias("status"))


def _impact(pct: Column) -> Column:
    return F.when(pct > 10, F.lit("high")).when(pct > 5, F.lit("medium")).otherwise(F.lit("low"))


def outliers_iqr(df: DataFrame, method: str = "exact", fenced: DataFrame | None = None) -> DataFrame:
    """A14 + K4: IQR fences per numeric column with ≥ 3 values; rows for
    columns with outliers, ordered by impact, count desc, column order.  ``fenced``: the table's ``fences``, if known."""
    f = fences(df, method) if fenced is None else fenced
    f = f.filter(F.col("n") >= 3).filter(F.col("outliers") > 0)
    pct = F.col("outliers") / F.col("n_all") * 100
    out = f.select(F.col("column").alias("feature"), "col_ord", F.col("outliers").alias("count"),
                   round_half(pct, 2).alias("percentage"), _impact(pct).alias("impact"),
                   "lower_bound", "upper_bound", "min_value", "max_value", "mean", "std")
    order = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    return out.withColumn("impact_ord", order).orderBy("impact_ord", F.col("count").desc(), "col_ord")


def outliers_zscore(df: DataFrame) -> DataFrame:
    """|z| > 3 with the population std for the mask; reported bounds use
    the sample std (quirk Q17).  Two wide passes."""
    num = numeric_columns(df, df.columns)
    at = _wide(df, num, {
        "n": lambda v, i: F.count(v), "n_all": lambda v, i: F.count(F.lit(1)), "mean": lambda v, i: F.avg(v), "sp": lambda v, i: F.stddev_pop(v),
        "std": lambda v, i: F.stddev_samp(v), "min_value": lambda v, i: F.min(v), "max_value": lambda v, i: F.max(v)})
    for a in at:
        ok = a["std"] is not None
        a["lower_bound"], a["upper_bound"] = (a["mean"] - 3 * a["std"], a["mean"] + 3 * a["std"]) if ok else (None, None)
    f = _outside(df, num, at, lambda v, a: np.abs(v - a["mean"]) / a["sp"] > 3 if a["sp"] and a["sp"] > 0 else np.zeros(len(v), bool))
    f = f.filter((F.col("n") >= 3) & (F.col("outliers") > 0))
    pct = F.col("outliers") / F.col("n_all") * 100
    return f.select(F.col("column").alias("feature"), "col_ord", F.col("outliers").alias("count"),
                    round_half(pct, 2).alias("percentage"), _impact(pct).alias("impact"),
                    "lower_bound", "upper_bound", "min_value", "max_value", "mean", "std")


def _strength(a: Column) -> Column:
    return (F.when(a >= 0.8, F.lit("very_strong")).when(a >= 0.6, F.lit("strong"))
             .otherwise(F.lit("moderate")))


_PAIRS = ("feature1 string, feature2 string, i int, j int, correlation double, "
          "abs_correlation double, strength string, direction string, is_strong boolean")
_CROSS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def cross_products(df: DataFrame, cols: list[str], centre: list[float], ranks: dict | None = None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i < j: sums over the rows that both columns have, less
    ``centre``.  Each task adds up matrices over its batches and gives a row a pair.  ``ranks``: for
    the place of a column its sorted values and what stands for each."""
    p = len(cols)
    mid = np.array(centre)[:, None]
    left, right = np.triu_indices(p, 1)
    sent = df.sparkSession.sparkContext.broadcast(ranks or {})  # at most SENT values

    def run(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            x = _matrix(batch)
            for k, (values, stand) in sent.value.items():
                x[k] = stand[np.minimum(np.searchsorted(values, x[k]), len(values) - 1)]
            x -= mid
            has = np.isfinite(x).astype(np.float64)
            x = np.where(has > 0, x, 0.0)
            sums, squares = x @ has.T, (x * x) @ has.T
            total += [has @ has.T, sums, sums.T, squares, squares.T, x @ x.T]
        yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *[pa.array(t[left, right]) for t in total]], names=["i", "j", *_CROSS])

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in _CROSS)
    return _numbers(df, cols).mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _CROSS])


def _correlation(cross: DataFrame) -> DataFrame:
    """(i, j, r); null where a column is constant on the pair's rows."""
    n, c = F.col("n"), F.col
    vx, vy = c("sxx") - c("sx") * c("sx") / n, c("syy") - c("sy") * c("sy") / n
    # what rounding leaves of a constant column's sum of squares isn't spread
    flat = (vx <= 1e-12 * c("sxx")) | (vy <= 1e-12 * c("syy"))
    return cross.select("i", "j", F.when((n > 0) & ~flat, (c("sxy") - c("sx") * c("sy") / n) / F.sqrt(vx * vy)).alias("r"))


def _pairs_table(r: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """The pairs (i, j, r) at the threshold or above, with their names and bands."""
    name = F.array(*[F.lit(c) for c in cols])
    p = r.filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= threshold))
    return p.select(F.element_at(name, F.col("i") + 1).alias("feature1"), F.element_at(name, F.col("j") + 1).alias("feature2"), "i", "j",
                    round_half(F.col("r"), 4).alias("correlation"),
                    round_half(F.abs("r"), 4).alias("abs_correlation"),
                    _strength(F.abs("r")).alias("strength"),
                    F.when(F.col("r") > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
                    (F.abs("r") >= 0.7).alias("is_strong"))


def _means(df: DataFrame, cols: list[str]) -> list[float]:
    """A middle of each column for the cross products (its mean; 0 without one)."""
    return [a["mean"] if a["mean"] is not None and math.isfinite(a["mean"]) else 0.0 for a in _wide(df, cols, {"mean": lambda v, i: F.avg(_real(v))})]


def pearson_pairs(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Upper-triangle pairs with |r| ≥ threshold, each over the rows that both columns have."""
    cols = numeric_columns(df, df.columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    return _pairs_table(_correlation(cross_products(df, cols, _means(df, cols))), cols, threshold)


def _null_patterns(df: DataFrame, cols: list[str]) -> list[list[int]]:
    """The columns in groups that have values in exactly the same rows."""
    count = {i: a["n"] for i, a in enumerate(_wide(df, cols, {"n": lambda v, i: F.count(_real(v))}))}
    rows = df.count()
    groups, rest = [[i for i in count if count[i] == rows]], [i for i in count if count[i] < rows]
    if len(rest) > 1:
        both = {(r["i"], r["j"]): r["n"] for r in cross_products(df, [cols[i] for i in rest], [0.0] * len(rest)).collect()}  # a row a pair of columns with nulls
    for k, i in enumerate(rest):
        own = next((g for g in groups[1:] if count[g[0]] == count[i] == both[rest.index(g[0]), k]), None)
        groups.append([i]) if own is None else own.append(i)
    return [g for g in groups if g]


def _rank_products(table: DataFrame, names: list[str]) -> DataFrame:
    """``cross_products`` of the average ranks of rows (rid and columns without nulls)."""
    arr = lambda own: F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in own])
    cells = lambda own: table.select("rid", F.explode(arr(own)).alias("x")).select("rid", "x.k", "x.v")
    every = list(enumerate(names))
    counts = cells(every).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = with_running_sum(counts, ["k"], ["v"], "c", "upto")
    rank = upto.select("k", "v", (F.col("upto") - (F.col("c") - 1) / 2.0).alias("rank"))
    size = {r["k"]: (r["values"], r["rows"]) for r in upto.groupBy("k").agg(F.count(F.lit(1)).alias("values"), F.max("upto").alias("rows")).collect()}  # a row a column
    if not size:
        return cross_products(table, names, [0.0] * len(names))
    sent, total = set(), 0
    for k in sorted(size, key=lambda k: size[k][0]):
        if (total := total + size[k][0]) <= SENT:
            sent.add(k)
    got = rank.filter(F.col("k").isin(list(sent))).toPandas().sort_values(["k", "v"]) if sent else None  # at most SENT rows
    lookup = {int(k): (g["v"].to_numpy(), g["rank"].to_numpy()) for k, g in got.groupby("k")} if sent else {}
    large = [(k, c) for k, c in every if k not in sent]
    if large:
        joined = cells(large).join(rank, ["k", "v"]).groupBy("rid").agg(*[F.max(F.when(F.col("k") == k, F.col("rank"))).alias(c) for k, c in large])
        table = table.drop(*[c for _, c in large]).join(joined, "rid")
    return cross_products(table, names, [size[0][1] / 2.0] * len(names), lookup)


def spearman_pairs(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spearman per pair on the rows complete for that pair.

    Columns that have values in the same rows are one group.  For each pair of groups (and each
    group with itself) the rows that both have are ranked once, all columns together."""
    cols = numeric_columns(df, df.columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    spark, names = df.sparkSession, [f"v{i}" for i in range(len(cols))]
    path = f"{checkpoint_dir(spark).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    df.select(F.monotonically_increasing_id().alias("rid"), *[_real(_q(c).cast("double")).alias(n) for c, n in zip(cols, names)]).write.parquet(path)
    table = spark.read.parquet(path)
    groups = _null_patterns(table, names)
    found = []
    for a in range(len(groups)):
        for b in range(a, len(groups)):
            own = sorted({*groups[a], *groups[b]})
            pairs = [(k, m) for k in range(len(own)) for m in range(k + 1, len(own))
                     if (own[k] in groups[a]) != (own[m] in groups[a]) or a == b]
            if not pairs:
                continue
            mine = [names[i] for i in own]
            whole = table.select("rid", *mine).filter(F.col(names[groups[a][0]]).isNotNull() & F.col(names[groups[b][0]]).isNotNull())
            cross = _rank_products(whole, mine)
            place = F.array(*[F.lit(i) for i in own])
            wanted = F.array(*[F.lit(k * len(own) + m) for k, m in pairs])
            cross = cross.filter(F.array_contains(wanted, F.col("i") * len(own) + F.col("j")))
            found.append(_correlation(cross).select(F.element_at(place, F.col("i") + 1).alias("i"), F.element_at(place, F.col("j") + 1).alias("j"), "r"))
    return _pairs_table(functools.reduce(DataFrame.unionByName, found), cols, threshold)


def insights_summary(quality: DataFrame, outliers: DataFrame, pairs: DataFrame) -> DataFrame:
    """The summary sentence, built from the three small result tables
    (one row per dataset; outlier and pair tables carry ``dataset_id``)."""
    q = quality.select("dataset_id", "overall_score", "completeness", "total_rows")
    o = outliers.groupBy("dataset_id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_outliers"),
                     F.count(F.lit(1)).alias("affected"),
                     F.slice(F.transform(F.array_sort(F.collect_list(F.when(
                         F.col("impact") == "high", F.struct(-F.col("count"), "col_ord", "feature")))),
                         lambda s: s["feature"]), 1, 3).alias("high_feats"))
    top = (pairs.filter("is_strong").groupBy("dataset_id")
                .agg(F.min_by(F.struct("direction", "correlation", "feature1", "feature2"),
                               F.struct(-F.col("abs_correlation"), "i", "j")).alias("top")))
    j = q.join(o, "dataset_id", "left").join(top, "dataset_id", "left")
    j = j.withColumn("total_outliers", F.coalesce("total_outliers", F.lit(0))) \
         .withColumn("high_feats", F.coalesce("high_feats", F.array().cast("array<string>")))
    s = F.col("overall_score")
    quality_txt = (F.when(s >= 90, F.format_string(
        "Your dataset shows excellent quality with a %.1f%% overall score.", s))
        .when(s >= 75, F.format_string("Your dataset shows good quality with a %.1f%% overall score.", s))
        .when(s >= 60, F.format_string(
            "Your dataset has moderate quality (%.1f%% score) and could benefit from improvements.", s))
        .otherwise(F.format_string("Your dataset needs attention with a %.1f%% quality score.", s)))
    parts = F.concat_ws(" ", quality_txt,
                        F.when(F.col("total_outliers") > 0, F.format_string(
                            "Found %d outliers across %d features.", F.col("total_outliers"),
                            F.col("affected"))),
                        F.when((F.col("total_outliers") > 0) & (F.size("high_feats") > 0), F.concat(
                            F.lit("High-impact outliers detected in: "),
                            F.array_join("high_feats", ", "), F.lit("."))),
                        F.when(F.col("top").isNotNull(), F.format_string(
                            "Strong %s correlation (%.2f) found between %s and %s.",
                            F.col("top.direction"), F.col("top.correlation"), F.col("top.feature1"),
                            F.col("top.feature2"))),
                        F.when(F.col("completeness") < 95, F.lit(
                            "Consider handling missing values to improve data completeness.")),
                        F.when(F.col("total_outliers") > F.col("total_rows") * 0.05, F.lit(
                            "Review and potentially remove or transform outliers before model training.")))
    return j.select("dataset_id", parts.alias("summary"))


def quality_status(quality: DataFrame) -> DataFrame:
    """Per-measure bands (95/80; uniqueness 70/50) and the issue list."""
    band = (lambda c, hi, lo: F.when(F.col(c) >= hi, F.lit("good")).when(F.col(c) >= lo, F.lit("warning"))
            .otherwise(F.lit("poor")))
    issues = F.array_compact(F.array(
        F.when(F.col("missing_values") > 0, F.format_string("%d missing values detected", F.col("missing_values"))),
        F.when(F.col("completeness") < 95, F.format_string("Completeness is %.1f%% (below 95%%)", F.col("completeness"))),
        F.when(F.col("validity") < 95, F.format_string("Data validity is %.1f%% (below 95%%)", F.col("validity"))),
        F.when(F.col("uniqueness") < 70, F.format_string("Uniqueness is %.1f%% (below 70%%)", F.col("uniqueness")))))
    return quality.select("dataset_id", band("completeness", 95, 80).alias("completeness_status"),
                          band("validity", 95, 80).alias("validity_status"),
                          band("uniqueness", 70, 50).alias("uniqueness_status"),
                          band("consistency", 95, 80).alias("consistency_status"),
                          F.array_join(issues, "; ").alias("issues"))
