"""Models fitted per fold, out-of-fold predictions, native importance.

``prepared`` indexes, one-hot encodes and assembles the features once, into a table written to the
shared folder; all fits read it in the same parts, of a bounded number of rows each.  ``out_of_fold`` fits every algorithm on each fold's training part
(``counted``; else with MLlib: each fit is distributed, on small tables several are submitted at a time, as such a fit
doesn't fill a cluster) and scores the part held out, so each row has one prediction a model, made by a
model that hasn't seen it.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from trustframe.operators.counted import out_of_fold_scores
from trustframe.session import checkpoint_dir

ROWS_A_TASK, MOST_ROWS_A_TASK, USUAL_TASKS = 100_000, 250_000, 48
#: rows of all fits that run at a time: each keeps its rows in memory, a forest about 1 KB for each (its 200 draws)
ROWS_AT_ONCE = 16_000_000
ALGORITHMS = ["LogisticRegression", "RandomForest", "BoostedTrees"]


@dataclass(frozen=True)
class Fits:
    """Fixed values of the model comparison: 200 trees, 200 rounds of depth 5 at a rate of 0.1.

    A forest's trees have a depth of at most ``forest_depth``, as MLlib asks for a bound."""

    trees: int = 200
    forest_depth: int = 5
    rounds: int = 200
    depth: int = 5
    rate: float = 0.1
    seed: int = 42

    def estimator(self, algorithm: str, rows: int):
        if algorithm == "RandomForest":
            return RandomForestClassifier(labelCol="label", numTrees=self.trees, maxDepth=self.forest_depth, seed=self.seed)
        if algorithm == "BoostedTrees":
            return GBTClassifier(labelCol="label", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, seed=self.seed)
        # half the squared weights of the standardised features beside the summed loss
        return LogisticRegression(labelCol="label", maxIter=1000, regParam=1.0 / max(1, rows), tol=1e-9)


def prepared(df: DataFrame, label: str, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with ``label`` (double) and ``features``, written once; and the features' names.

    Categories are schema here (all rows); an unknown or null one is all zeros."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_hot" for c in categorical])] if categorical else []  # the last one, unknown, is dropped
    assemble = VectorAssembler(inputCols=[*numeric, *[f"{c}_hot" for c in categorical]], outputCol="features", handleInvalid="keep")
    made = Pipeline(stages=[*idx, *hot, assemble]).fit(df)
    names = numeric + [f"{c}={v}" for c, m in zip(categorical, made.stages) for v in m.labels]
    rows = made.transform(df).select(*df.columns, F.col(label).cast("double").alias("label"), "features")
    checkpoint_dir(df.sparkSession)
    # a checkpoint keeps its parts; of files, a reader puts many small ones into one task
    return rows.repartition(parts(df.count())).checkpoint(eager=True), names


def parts(rows: int) -> int:
    """Tasks of a hundred thousand rows, as a tree's rounds are hundreds of short jobs over the table; of more rows on large tables."""
    return max(1, -(-rows // MOST_ROWS_A_TASK), min(USUAL_TASKS, -(-rows // ROWS_A_TASK)))


def fit(train: DataFrame, algorithm: str, fits: Fits = Fits()) -> Model:
    return fits.estimator(algorithm, train.count()).fit(train.select("label", "features"))


def out_of_fold(table: DataFrame, fold: str, folds: int, algorithms: list[str] = ALGORITHMS, fits: Fits = Fits(), at_once: int = 8) -> DataFrame:
    """The rows with model_id, y_pred and score (the probability of class 1) from models fitted without their fold.

    Trees are grown on counted cells and logistic weights found in a few passes (``counted``); where cells would be
    too many, MLlib fits on the rows."""
    known = [a for a in algorithms if a in ALGORITHMS]
    if len(known) == len(algorithms) and (out := out_of_fold_scores(table, fold, folds, known, fits)) is not None:
        return out

    def one(algorithm: str, k: int) -> DataFrame:
        model = fit(table.filter(F.col(fold) != k), algorithm, fits)
        scored = model.transform(table.filter(F.col(fold) == k))
        return scored.select(F.lit(algorithm).alias("model_id"), *[c for c in table.columns if c not in ("label", "features")],
                             F.col("prediction").alias("y_pred"), F.element_at(vector_to_array("probability"), 2).alias("score"))

    jobs = [(a, k) for a in sorted(algorithms, key=lambda a: a != "BoostedTrees") for k in range(folds)]
    with ThreadPoolExecutor(max(1, min(at_once, ROWS_AT_ONCE // max(1, table.count())))) as pool:
        parts = list(pool.map(lambda job: inheritable_thread_target(table.sparkSession)(one)(*job), jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def native_importance(spark: SparkSession, model: Model, names: list[str]) -> DataFrame:
    """Feature, importance (share of the whole), read from a fitted model: the impurity decrease
    of a tree model, the absolute weights of a linear one; K5 order in ``rank``."""
    if hasattr(model, "featureImportances"):
        raw = model.featureImportances.toArray().tolist()
    else:
        raw = [abs(x) for x in model.coefficients.toArray().tolist()]
    total = sum(raw) or 1.0
    order = sorted(range(len(raw)), key=lambda i: (-raw[i], i))  # as many as the model has features
    rows = [(names[i], raw[i] / total, r) for r, i in enumerate(order, 1)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")
