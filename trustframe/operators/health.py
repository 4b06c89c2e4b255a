"""Dataset statistics that feed the instability index, of any number of datasets in one job.

Every dataset becomes rows of one narrow shape (dataset, numeric slots, null
cells, label, two 64-bit fingerprints of the row) in one union keyed by
``dataset_id``.  Row counts, null cells, sample variance and skewness of the
slots are one aggregation, combined in each map task.  Exact duplicates are
counted on fingerprints, so the shuffle carries 16 bytes and the label of a
row and never the row; the whole rows are compared only where a fingerprint
repeats (``repeated_rows``), so a collision changes nothing.  Class counts
come from the same fingerprint table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.expr import lit_d

_FP = ["dataset_id", "_h1", "_h2"]


@dataclass(frozen=True)
class Dataset:
    """A table with its id, target and features (None: all columns but the target)."""
    df: DataFrame
    dataset_id: str
    target: str
    features: list[str] | None = None
    model_type: str = "classification"


def numeric_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """pandas ``select_dtypes(include=number)``: ints and floats, not booleans."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in cols if isinstance(types[c], T.NumericType)]


def corrected_skew(c: str) -> F.Column:
    """Bias-corrected sample skewness (pandas ``skew``); 0 for a constant
    column, null below 3 values."""
    n = F.count(F.col(c)).cast("double")
    g1 = F.skewness(F.col(c))
    return F.when(n >= 3, F.coalesce(g1, lit_d(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def _cells(df: DataFrame) -> list[Column]:
    """The columns with one form for each value (0.0 and -0.0 are equal)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(F.when(c == 0, F.lit(0).cast(f.dataType)).otherwise(c)
                   if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c)
    return out


def fingerprint_columns(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of the whole row; nulls count by their column."""
    cells = _cells(df)
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return F.xxhash64(*cells, nulls), F.xxhash64(F.lit("second"), *reversed(cells), nulls)


def repeated_rows(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(dataset_id, _dups): rows beyond the first of each distinct row.  Whole rows (``_row``) are compared
    only where a fingerprint has two rows or more; a row copied a billion times is one row a map task."""
    again = counts.filter(F.col("_c") > 1).select(*_FP)
    whole = rows.select(*_FP, "_row").join(again, _FP, "left_semi").groupBy(*_FP, "_row").agg(F.count(F.lit(1)).alias("_c"))
    return whole.groupBy("dataset_id").agg(F.sum(F.col("_c") - 1).alias("duplicates"))


def many_dataset_stats(datasets: list[Dataset], variant: str = "service") -> DataFrame:
    """One row a dataset: n_rows, n_features, missing_values (target included), duplicate_ratio,
    low_variance_fraction, skew_score, imbalance_ratio.

    ``variant='service'`` is the evaluation service rule (A11);
    ``variant='experiment'`` is the experiment scripts' rule (A12):
    imbalance = min/max class count and skew = tanh(mean |skew| / 3).
    An empty dataset has n_rows 0, no missing values and no duplicates.
    Columns of any type that Spark can group by may occur."""
    if len({d.dataset_id for d in datasets}) != len(datasets):
        raise ValueError("dataset ids must differ")
    spark = datasets[0].df.sparkSession
    feats = [d.features if d.features is not None else [c for c in d.df.columns if c != d.target] for d in datasets]
    nums = [numeric_columns(d.df, f) for d, f in zip(datasets, feats)]
    slots = max(len(n) for n in nums)
    parts = []
    for d, num in zip(datasets, nums):
        h1, h2 = fingerprint_columns(d.df)
        label = F.col(f"`{d.target}`").cast("string") if d.model_type == "classification" else F.lit(None).cast("string")
        missing = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in d.df.columns), F.lit(0))
        vals = [F.col(f"`{num[i]}`").cast("double") if i < len(num) else F.lit(None).cast("double")
                for i in range(slots)]
        row = F.array(*[c.cast("string") for c in _cells(d.df)])
        parts.append(d.df.select(F.lit(d.dataset_id).alias("dataset_id"), missing.cast("long").alias("_miss"),
                                 label.alias("_label"), h1.alias("_h1"), h2.alias("_h2"), row.alias("_row"),
                                 *[v.alias(f"_v{i}") for i, v in enumerate(vals)]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum("_miss").alias("missing_values")]
    for i in range(slots):
        aggs += [F.var_samp(f"_v{i}").alias(f"v{i}"), corrected_skew(f"_v{i}").alias(f"s{i}")]
    base = rows.groupBy("dataset_id").agg(*aggs)
    counts = rows.groupBy(*_FP, "_label").agg(F.count(F.lit(1)).alias("_c"))
    dups = repeated_rows(rows, counts)
    classes = (counts.filter(F.col("_label").isNotNull()).groupBy("dataset_id", "_label").agg(F.sum("_c").alias("n"))
                     .groupBy("dataset_id").agg(F.min("n").alias("_min_class"), F.max("n").alias("_max_class")))

    meta = [F.struct(F.lit(d.dataset_id).alias("dataset_id"), F.lit(len(f)).alias("n_features"),
                     F.lit(len(n)).alias("_slots"), F.lit(d.model_type == "classification").alias("_labelled"))
            for d, f, n in zip(datasets, feats, nums)]
    out = (spark.range(1).select(F.inline(F.array(*meta))).join(base, "dataset_id", "left")
           .join(dups, "dataset_id", "left").join(classes, "dataset_id", "left")
           .withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
           .withColumn("missing_values", F.coalesce("missing_values", F.lit(0).cast("long"))))
    low = sum((F.when(F.col(f"v{i}") < 0.01, 1).otherwise(0) for i in range(slots)), F.lit(0))
    skews = [F.abs(F.col(f"s{i}")) for i in range(slots)]
    n_ok = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in skews), F.lit(0))
    tot = sum((F.coalesce(s, lit_d(0.0)) for s in skews), lit_d(0.0))
    mean_skew = F.when(n_ok > 0, tot / n_ok)
    n = F.greatest(F.col("n_rows"), F.lit(1))
    if variant == "experiment":
        skew = F.coalesce(F.tanh(mean_skew / 3.0), lit_d(0.0))
        imbalance = F.when(F.col("_labelled"), F.col("_min_class") / F.col("_max_class")).otherwise(lit_d(0.5))
    else:
        # Q14: min(1, NaN) is 1 in Python, so "no column with ≥3 values" scores 1
        skew = F.when(mean_skew.isNull(), lit_d(1.0)).otherwise(F.least(lit_d(1.0), mean_skew / 3.0))
        imbalance = F.coalesce(F.col("_max_class") / F.col("n_rows"), lit_d(0.5))
    any_num = F.col("_slots") > 0
    return out.select(
        "dataset_id", "n_rows", "n_features", "missing_values", imbalance.alias("imbalance_ratio"),
        (F.coalesce("duplicates", F.lit(0)) / n).alias("duplicate_ratio"),
        F.when(any_num, skew).otherwise(lit_d(0.0)).alias("skew_score"),
        F.when(any_num, low / F.col("_slots")).otherwise(lit_d(0.0)).alias("low_variance_fraction"))


def dataset_stats(df: DataFrame, dataset_id: str, target: str, features: list[str] | None = None,
                  model_type: str = "classification", variant: str = "service") -> DataFrame:
    """``many_dataset_stats`` of one dataset."""
    return many_dataset_stats([Dataset(df, dataset_id, target, features, model_type)], variant)
