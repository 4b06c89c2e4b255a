"""Row positions, positional / stratified splits, folds and order statistics.

The reference splits an in-memory frame by position (first 80 % train).  A
window ``row_number() over (partition by k order by c)`` would send every row
of one key to one task, and a key may hold a third of all rows.  Instead
``with_position`` computes the exact 0-based position inside each group with
a range shuffle:

1. range-partition on ``(group, order)`` and sort inside partitions;
2. ``monotonically_increasing_id`` gives the local index inside a partition;
3. a tiny table of per-(partition, group) counts gives each partition's
   offset inside its group (a window over at most partitions + groups rows);
4. position = offset + local index.

The range exchange samples its boundaries per execution, so the two uses
(counts and the final join) must read one materialisation: the ranged rows
with their local index are written once with a reliable ``checkpoint()`` to
the session's checkpoint folder.  That also makes positions survive executor
loss.  The order key must be unique inside a group (callers append
``row_id``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.expr import lit_d
from trustframe.session import checkpoint_dir

_PID_SHIFT = 33  # monotonically_increasing_id layout: partition id << 33


def with_position(df: DataFrame, by: list[str], order: list[Column | str],
                  pos_col: str = "pos", size_col: str = "group_n",
                  num_partitions: int | None = None) -> DataFrame:
    """Add the exact 0-based position of each row inside its ``by`` group."""
    spark = df.sparkSession
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in by] + order_cols
    # without an explicit count AQE may coalesce adjacent ranges (order kept);
    # the partition ids are fixed by the checkpoint below
    rp = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = (rp.sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_local", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), _PID_SHIFT)))
    checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid", *by).agg(F.min("_local").alias("_start"),
                                            F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_pid") if by else Window.orderBy("_pid")
    offsets = (counts
               .withColumn("_base", F.coalesce(F.sum("_cnt").over(
                   w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn(size_col, F.sum("_cnt").over(
                   (Window.partitionBy(*by) if by else Window.partitionBy())))
               .select("_pid", *by, "_start", "_base", size_col))
    if not by:
        # at most one row per shuffle partition: bounded by configuration
        offsets = F.broadcast(offsets)
    out = ranged.join(offsets, on=["_pid", *by], how="inner")
    return (out.withColumn(pos_col, F.col("_base") + F.col("_local") - F.col("_start"))
               .drop("_pid", "_local", "_start", "_base"))


def _ordered(c: Column, t: T.DataType) -> Column:
    """A number in the order of a date or number key."""
    return F.unix_date(c) if isinstance(t, T.DateType) else c


def global_rank(df: DataFrame, key: Column, rank_of, accuracy: int = 200000):
    """(n, k, v, below, ties): the value ``v`` at the 0-based rank ``k = rank_of(n)`` of a number over all
    rows, and how many rows lie below it and equal it; v is None if no row has that rank, and the
    result is None if a key is null or NaN.

    Scalars alone reach the driver.  ``percentile_approx`` brackets the rank; while a bracket holds more
    than ``accuracy`` rows, it is bracketed again, about accuracy/8 times narrower each time, so 10^12
    keys take three scans; what is left is at most ``accuracy`` keys, sorted in one row.  A bracket
    that misses the rank (keys beyond a double) or doesn't narrow (one value many times) is halved by value."""
    base = df.select(key.alias("_v"))
    m = 4.0 / accuracy
    rows, n, lo, hi = base.agg(F.count(F.lit(1)), F.count("_v"), F.min("_v"), F.max("_v")).first()
    if rows != n or hi != hi:
        return None
    k = rank_of(n)
    if not 0 <= k < n:
        return n, k, None, n, 0
    below, inside = 0, n
    while inside > accuracy and lo != hi:
        cell = base.filter(F.col("_v").between(F.lit(lo), F.lit(hi)))
        q = (k - below) / inside
        g = cell.agg(F.percentile_approx("_v", [max(0.0, q - m), min(1.0, q + m)], accuracy)).first()[0]
        under, held = _bracket_counts(cell, g[0], g[1])
        if below + under <= k < below + under + held and (held < inside or g[0] == g[1]):
            lo, hi, below, inside = g[0], g[1], below + under, held
            continue
        mid = min(lo + (hi - lo) / 2, math.nextafter(hi, lo)) if isinstance(lo, float) else lo + (hi - lo) // 2
        held = _bracket_counts(cell, lo, mid)[1]
        if k < below + held:
            hi, inside = mid, held
        else:
            lo = cell.filter(F.col("_v") > F.lit(mid)).agg(F.min("_v")).first()[0]
            below, inside = below + held, inside - held
    if lo == hi:
        return n, k, lo, below, inside
    held = base.filter(F.col("_v").between(F.lit(lo), F.lit(hi))).agg(F.sort_array(F.collect_list("_v")).alias("_h"))
    v, at, ties = (held.withColumn("_x", F.element_at("_h", int(k - below + 1)))
                       .select("_x", F.array_position("_h", F.col("_x")), F.size(F.filter("_h", lambda x: x == F.col("_x")))).first())
    return n, k, v, below + at - 1, ties


def _bracket_counts(cell: DataFrame, lo, hi) -> tuple[int, int]:
    """How many keys lie below ``lo``, and from ``lo`` to ``hi``."""
    zero = F.lit(0).cast("long")
    return tuple(cell.agg(F.coalesce(F.sum((F.col("_v") < F.lit(lo)).cast("long")), zero),
                          F.coalesce(F.sum(F.col("_v").between(F.lit(lo), F.lit(hi)).cast("long")), zero)).first())


def _first_part(df: DataFrame, order: list[str], train_fraction: float) -> Column | None:
    """Whether a row is among the first ``floor(f * n)`` of the whole table by ``order``, as an expression
    over its columns; None if the first key is neither a number nor a date, or has a null or NaN.

    The leading key's boundary value comes from ``global_rank``; only the rows that tie on it are
    ranked by the other keys, and the one at the boundary gives the rest of the expression."""
    t = df.schema[order[0]].dataType
    if not isinstance(t, (T.IntegralType, T.FloatType, T.DoubleType, T.DateType)):
        return None
    lead = _ordered(F.col(order[0]), t)
    found = global_rank(df, lead, lambda n: int(math.floor(float(n) * train_fraction)))
    if found is None:
        return None
    n, k, v, below, ties = found
    if v is None or below == k:  # the cut lies before the ties, or there are no rows
        return lead < F.lit(v) if v is not None else F.lit(k >= n)
    if len(order) == 1:
        return None
    rest = with_position(df.filter(lead == F.lit(v)).select(*order[1:]), [], [F.col(c) for c in order[1:]], "_pos", "_n")
    edge = rest.filter(F.col("_pos") == F.lit(k - below)).select(*order[1:]).first()
    less, same = lead < F.lit(v), lead == F.lit(v)
    for c in order[1:]:  # nulls come first
        e = F.lit(edge[c]).cast(df.schema[c].dataType)
        less = less | (same & (F.col(c).isNull() & F.lit(edge[c] is not None) | F.coalesce(F.col(c) < e, F.lit(False))))
        same = same & F.col(c).eqNullSafe(e)
    taken = rest.filter(F.col("_pos") < F.lit(k - below))
    equal = F.lit(True)
    for c in order[1:]:
        equal = equal & F.col(c).eqNullSafe(F.lit(edge[c]).cast(df.schema[c].dataType))
    return less if taken.filter(equal).isEmpty() else None  # equal keys on both sides: positions decide


def positional_split(df: DataFrame, by: list[str], order: list[str],
                     train_fraction: float = 0.8, split_col: str = "split",
                     unique_numeric_key: bool = False) -> DataFrame:
    """first ``floor(train_fraction * n)`` rows of each group are 'train'.

    Without groups the split is an expression over the order keys (``_first_part``: scans
    and a sort of the rows that tie on the leading key), so the table is neither sorted nor
    rewritten.  With groups and a single unique numeric key it is ``key < v`` where v is the group's
    exact ⌊f·n⌋-th key (``order_statistics``).  Otherwise positions come from ``with_position``."""
    first = _first_part(df, order, train_fraction) if not by else None
    if first is not None:
        return df.withColumn(split_col, F.when(first, F.lit("train")).otherwise(F.lit("test")))
    if unique_numeric_key and len(order) == 1:
        cut = order_statistics(df, by, order[0], [("_cut", train_fraction, "floor_n")]).drop("n")
        j = df.join(cut, by) if by else df.withColumn("_j", F.lit(1)).join(
            F.broadcast(cut.withColumn("_j", F.lit(1))), "_j").drop("_j")
        return (j.withColumn(split_col, F.when(F.col(order[0]) < F.col("_cut"), F.lit("train"))
                             .otherwise(F.lit("test"))).drop("_cut"))
    p = with_position(df, by, order, "_pos", "_n")
    cut = F.floor(F.col("_n") * lit_d(train_fraction))
    return (p.withColumn(split_col, F.when(F.col("_pos") < cut, F.lit("train"))
                         .otherwise(F.lit("test")))
             .drop("_pos", "_n"))


def stratified_split(df: DataFrame, by: list[str], label: str, row_id: str,
                     test_fraction: float = 0.3, split_col: str = "split") -> DataFrame:
    """inside every (group, label) stratum, ordered by md5(row_id), the
    first ``ceil(test_fraction * n)`` rows are 'test', the rest 'train'."""
    p = with_position(df, [*by, label], [F.md5(F.col(row_id).cast("string")), F.col(row_id)],
                      "_pos", "_n")
    cut = F.ceil(F.col("_n") * lit_d(test_fraction))
    return (p.withColumn(split_col, F.when(F.col("_pos") < cut, F.lit("test"))
                         .otherwise(F.lit("train")))
             .drop("_pos", "_n"))


def stratified_folds(df: DataFrame, by: list[str], label: str, row_id: str,
                     k: int = 5, fold_col: str = "fold") -> DataFrame:
    """fold = position inside (group, label) by md5(row_id), modulo k."""
    p = with_position(df, [*by, label], [F.md5(F.col(row_id).cast("string")), F.col(row_id)],
                      "_pos", "_n")
    return p.withColumn(fold_col, (F.col("_pos") % k).cast("int")).drop("_pos", "_n")


def with_running_sum(df: DataFrame, by: list[str], order: list[Column | str], weight: str,
                     out_col: str = "running", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` inside each ``by`` group in
    ``order`` — the distributed form of ``sum(w) over (partition by by
    order by order rows unbounded preceding)`` with no single-task window:
    local sums inside range partitions + a small table of partition offsets."""
    spark = df.sparkSession
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in by] + order_cols
    rp = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = rp.withColumn("_pid", F.spark_partition_id())
    w = (Window.partitionBy("_pid", *by).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0))
    ranged = ranged.withColumn("_local", F.sum(weight).over(w))
    checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    tot = ranged.groupBy("_pid", *by).agg(F.sum(weight).alias("_tot"))
    wo = Window.partitionBy(*by).orderBy("_pid") if by else Window.orderBy("_pid")
    offsets = tot.withColumn("_base", F.coalesce(F.sum("_tot").over(
        wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_tot")
    if not by:
        offsets = F.broadcast(offsets)
    return (ranged.join(offsets, ["_pid", *by])
                  .withColumn(out_col, F.col("_base") + F.col("_local"))
                  .drop("_pid", "_local", "_base"))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: list[tuple[str, float, str]],
                     accuracy: int = 200000) -> DataFrame:
    """Exact values at given 0-based ranks inside each ``by`` group.

    ``ranks`` holds (name, q, rule): the rank is ``floor(q·(n−1))`` for rule
    'floor', ``ceil(q·(n−1))`` for 'ceil' and ``floor(q·n)`` for 'floor_n',
    with n the group's non-null count.  The value keeps its own type, so
    64-bit keys stay exact.

    One aggregation brackets every rank: ``percentile_approx`` at q ± 4/accuracy
    (rank error ≤ n/accuracy), or the group's minimum and maximum where the
    group has fewer rows than ``accuracy``.  One more counts the values below
    each bracket and the distinct values inside (about 8·n/accuracy), equal
    values combined map-side; their running sum, split over range partitions of
    distinct values, gives the value at the rank.  A bracket that misses its
    rank (as for keys beyond the sketch's double precision) is taken again, by
    itself, as the group's whole range.  Returns (by..., n, <name>...)."""
    base = df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    m = 4.0 / accuracy
    names = [r[0] for r in ranks]
    low = {nm: round(max(0.0, q - m), 9) for nm, q, _ in ranks}
    high = {nm: round(min(1.0, q + m), 9) for nm, q, _ in ranks}
    pct = sorted({*low.values(), *high.values()})
    nd = F.col("n").cast("double")

    def rank_of(q: float, rule: str) -> Column:
        if rule == "floor_n":
            return F.floor(nd * q).cast("long")
        return (F.floor if rule == "floor" else F.ceil)((nd - 1) * q).cast("long")

    checkpoint_dir(df.sparkSession)
    a = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", pct, accuracy).alias("_g"),
                              F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    whole = F.col("n") < accuracy
    at = lambda share: F.element_at("_g", pct.index(share) + 1)
    wanted = a.select(*by, "n", "_min", "_max", F.explode(F.array(*[
        F.struct(F.lit(nm).alias("_r"), rank_of(q, rule).alias("_k"),
                 F.when(whole, F.col("_min")).otherwise(at(low[nm])).alias("_lo"),
                 F.when(whole, F.col("_max")).otherwise(at(high[nm])).alias("_hi")) for nm, q, rule in ranks])).alias("_w")
    ).select(*by, "n", "_min", "_max", "_w.*").checkpoint(eager=True)
    found = _values_at(base, by, wanted)
    missed = found.filter(F.col("_val").isNull() & (F.col("_k") < F.col("n")))
    if not missed.isEmpty():
        again = (missed.drop("_val").withColumn("_lo", F.col("_min")).withColumn("_hi", F.col("_max")))
        found = found.join(missed.select(*by, "_r"), [*by, "_r"], "left_anti").unionByName(_values_at(base, by, again))
    return found.groupBy(*by, "n").pivot("_r", names).agg(F.first("_val"))


def _values_at(base: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (by, _r, _k, _lo, _hi, ...) with _val: the value at rank _k if the bracket holds it."""
    brackets = wanted.groupBy(*by).agg(F.collect_list(F.struct("_r", "_lo", "_hi")).alias("_b"))  # one per rank
    if by:
        j = base.join(brackets, by)
    else:  # one row
        j = base.withColumn("_j", F.lit(1)).join(F.broadcast(brackets.withColumn("_j", F.lit(1))), "_j").drop("_j")
    # a rank's rows: its below-count in one row of null value, and each distinct value inside
    inside = F.filter("_b", lambda b: F.col("_v") <= b["_hi"])
    tagged = j.select(*by, "_v", F.explode(inside).alias("_x"))
    counts = (tagged.select(*by, F.col("_x._r").alias("_r"), F.when(F.col("_v") >= F.col("_x._lo"), F.col("_v")).alias("_v"))
              .groupBy(*by, "_r", "_v").agg(F.count(F.lit(1)).alias("_c"))).checkpoint(eager=True)
    below = counts.filter(F.col("_v").isNull()).select(*by, "_r", F.col("_c").alias("_below"))
    cum = with_running_sum(counts.filter(F.col("_v").isNotNull()), [*by, "_r"], ["_v"], "_c", "_cum").select(*by, "_r", "_v", "_cum", "_c")
    kl = wanted.join(below, [*by, "_r"], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    hit = (cum.join(kl.select(*by, "_r", "_k", "_below"), [*by, "_r"])
              .filter((F.col("_below") + F.col("_cum") > F.col("_k")) & (F.col("_below") + F.col("_cum") - F.col("_c") <= F.col("_k")))
              .select(*by, "_r", F.col("_v").alias("_val")))
    return wanted.join(hit, [*by, "_r"], "left").checkpoint(eager=True)
