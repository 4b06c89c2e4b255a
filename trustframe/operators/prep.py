"""Preparation, encoding, training and batch scoring.

Encodings are Column expressions built from the (small) list of distinct
values, which is read with one aggregation; MLlib pipelines are used for
training (M3) and scoring (M4), and any Column-expression model scores with
a plain projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunctive_filter(df: DataFrame, ranges: dict[str, tuple], not_equal: dict[str, list],
                       keep: list[str]) -> DataFrame:
    """range conditions AND not-equal conditions, then a projection."""
    cond = F.lit(True)
    for c, (lo, hi) in ranges.items():
        cond = cond & F.col(c).between(lo, hi)
    for c, vals in not_equal.items():
        for v in vals:
            cond = cond & (F.col(c) != F.lit(v))
    return df.filter(cond).select(*keep)


def resolve_attribute(columns: Column, requested: Column, dataset_attr: Column, metadata_attr: Column) -> Column:
    """requested, else the dataset's, else metadata's — each only if it
    is a column of the dataset; null means auto-detect (A10)."""
    ok = (lambda a: F.when(a.isNotNull() & F.array_contains(columns, a), a))
    return F.coalesce(ok(requested), ok(dataset_attr), ok(metadata_attr))


def binarise(c: Column, value: str, other: str = "Other") -> Column:
    """one value vs 'Other'."""
    return F.when(c == value, F.lit(value)).otherwise(F.lit(other))


def label_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """index of the value among the sorted distinct values (alphabetAsc).
    The distinct values form a small table joined back (broadcast when AQE
    sees it is small)."""
    d = df.select(col).distinct().filter(F.col(col).isNotNull())
    from trustframe.operators.splits import with_position
    idx = with_position(d, [], [F.col(col)], out, "_n").drop("_n")
    return df.join(idx, col, "left")


def one_hot(df: DataFrame, col: str, values: list[str], drop_first: bool = True,
            null_indicator: bool = False) -> DataFrame:
    """M1: 0/1 columns per category (drop-first optional, optional null
    indicator; unknown values map to all zeros)."""
    vals = sorted(values)[1:] if drop_first else sorted(values)
    out = df.select("*", *[F.when(F.col(col) == v, 1).otherwise(0).alias(f"{col}_{v}") for v in vals])
    if null_indicator:
        out = out.withColumn(f"{col}_nan", F.col(col).isNull().cast("int"))
    return out


def categories(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """The sorted non-null values of a column, for ``one_hot``: they become columns, so they are
    schema; a column of more than ``most`` values is an error, and belongs in ``label_index`` or a vector encoder."""
    rows = df.select(col).distinct().filter(F.col(col).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} values: too many for a column each")
    return sorted(str(r[0]) for r in rows)


def impute(df: DataFrame, numeric: list[str], categorical: list[str], other: list[str]) -> DataFrame:
    """M2: median (exact, distributed) for numeric, mode for categorical,
    0 for the rest."""
    from trustframe.operators.insights import long_values
    from trustframe.operators.splits import order_statistics
    fills = {}
    if numeric:
        lv = long_values(df, numeric)
        med = order_statistics(lv, ["column"], "value", [("lo", 0.5, "floor"), ("hi", 0.5, "ceil")])
        for r in med.collect():  # one row per numeric column
            fills[r["column"]] = (r["lo"] + r["hi"]) / 2.0
    for c in categorical:
        mode = (df.filter(F.col(c).isNotNull()).groupBy(c).count()
                  .orderBy(F.col("count").desc(), F.col(c)).first())
        if mode is not None:
            fills[c] = mode[0]
    for c in other:
        fills[c] = 0
    return df.fillna(fills)


def train_and_score(train: DataFrame, test: DataFrame, label: str, numeric: list[str],
                    categorical: list[str], algo: str = "logistic", seed: int = 42) -> DataFrame:
    """M3 + M4: MLlib pipeline (index + one-hot + assemble + model), fitted
    on ``train`` and applied to ``test``; returns ``test`` with ``y_pred``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                        outputCols=[f"{c}_ohe" for c in categorical], dropLast=True) if categorical else None
    asm = VectorAssembler(inputCols=numeric + [f"{c}_ohe" for c in categorical], outputCol="features",
                          handleInvalid="keep")
    if algo == "random_forest":
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=200, seed=seed)
    elif algo == "boosted_trees":
        clf = GBTClassifier(labelCol=label, featuresCol="features", maxIter=200, maxDepth=5, stepSize=0.1,
                            seed=seed)
    else:
        clf = LogisticRegression(labelCol=label, featuresCol="features", maxIter=100)
    stages = idx + ([ohe] if ohe else []) + [asm, clf]
    model = Pipeline(stages=stages).fit(train.withColumn(label, F.col(label).cast("double")))
    return model.transform(test).withColumn("y_pred", F.col("prediction"))


def score_expression(df: DataFrame, model, features: list[str], out: str = "y_pred") -> DataFrame:
    """M4 (Column-expression backend): ``model(dict of feature Columns)``."""
    return df.withColumn(out, model({c: F.col(c) for c in features}))


def align_columns(df: DataFrame, reference: list[str], keep_suffix: str = "_nan") -> DataFrame:
    """Select the reference column list (missing ones as 0), keeping any
    ``*_nan`` indicator columns the frame has."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(0).alias(c) for c in reference]
    extra = [F.col(c) for c in df.columns if c.endswith(keep_suffix) and c not in reference]
    return df.select(*cols, *extra)
