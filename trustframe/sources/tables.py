"""Reading tables.

Parquet is the default; CSV is supported with the pandas missing-value tokens
mapped to null after the read (Spark CSV takes a single ``nullValue``), and
NaN is normalised to null so that "missing" has one meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The missing-value tokens pandas' CSV reader recognises by default.
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                    "n/a", "nan", "null"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def na_to_null(df: DataFrame) -> DataFrame:
    """Text columns with the missing-value tokens as null."""
    q = (lambda c: F.col(f"`{c}`"))
    return df.select(*[F.when(F.trim(q(c)).isin(PANDAS_NA_TOKENS), None).otherwise(q(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> dict[str, str | None]:
    """The type of each text column's values (bigint, double, or None for text), in one aggregate.

    An all-missing column is float in pandas: bigint needs a value."""
    q = (lambda c: F.col(f"`{c}`"))
    tc = (lambda c, t: F.expr(f"try_cast(`{c}` AS {t})"))
    checks = df.agg(*[x for i, c in enumerate(df.columns) for x in (
        ((F.count(q(c)) == F.count(tc(c, "BIGINT"))) & (F.count(q(c)) > 0)).alias(f"l{i}"),
        (F.count(q(c)) == F.count(tc(c, "DOUBLE"))).alias(f"d{i}"))]).first()  # one row of flags
    return {c: "bigint" if checks[f"l{i}"] else "double" if checks[f"d{i}"] else None for i, c in enumerate(df.columns)}


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """CSV with header (schema inferred unless given) or parquet."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt != "csv":
        return nan_to_null(spark.read.parquet(path))
    # read text, map the NA tokens to null, then infer types (as pandas does)
    df = na_to_null(spark.read.option("header", "true").csv(path))
    q = (lambda c: F.col(f"`{c}`"))
    if schema is not None:
        return nan_to_null(df.select(*[q(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
    types = infer_types(df)
    return nan_to_null(df.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) if t else q(c) for c, t in types.items()]))


def column_roles(df: DataFrame, target: str | None = None) -> tuple[str, list[str]]:
    """S3: target = the named column if present, else the last column."""
    cols = df.columns
    tgt = target if target in cols else cols[-1]
    return tgt, [c for c in cols if c != tgt]
