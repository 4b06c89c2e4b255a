"""S1, S2, S3, S12 chained: datasets read through the registry, many files in one job.

A registry row names a dataset's folder or file, its format and its columns.  Datasets of one format
and one list of columns are read together, whatever their number; each row is keyed by the path of
the file that it came from, so no dataset needs a job of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.operators.registry import owned_by
from trustframe.session import checkpoint_dir
from trustframe.sources.tables import column_roles, infer_types, na_to_null, nan_to_null


def plain_path(c: Column) -> Column:
    """A file's path without scheme and host, and without the escapes of a URL."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "")


def export_datasets(df: DataFrame, dataset_id: str, user_id: Column, fmt: str) -> DataFrame:
    """S12 and the registry's rows: one folder a dataset in the shared folder, written in one job.

    A null id gets a dataset '-'.  A dataset's rows may lie in many files, so a large one isn't one task's."""
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/datasets-{uuid.uuid4().hex}"
    cols = [c for c in df.columns if c != dataset_id]
    key = F.coalesce(F.col(dataset_id).cast("string"), F.lit("-"))
    keyed = df.select(F.md5(key).alias("_folder"), *[F.col(f"`{c}`") for c in cols])
    w = keyed.write.partitionBy("_folder")
    (w.option("header", "true").option("nullValue", "").csv(root) if fmt == "csv" else w.parquet(root))
    return df.select(key.alias("dataset_id"), user_id.cast("bigint").alias("user_id")).distinct().select(
        "dataset_id", "user_id", F.concat(F.lit(f"{root}/_folder="), F.md5("dataset_id")).alias("location"),
        F.lit(fmt).alias("format"), F.array(*[F.lit(c) for c in cols]).alias("columns"))


def read_registered(spark: SparkSession, registry: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """(columns, rows with the dataset's id in ``_id``) of every kind of dataset in ``registry``, one read a kind.

    The registry's rows (already an owner's, see ``read_owned``) go to the driver, as Spark's reader
    takes a list of paths; no data does.  CSV cells are read as text, missing-value tokens become
    null and types are inferred over the datasets of a kind (S1).  A CSV file whose header isn't
    the registered one is an error.  Paths must be unique; an empty registry gives an empty list."""
    kinds: dict[tuple, list] = {}
    for r in registry.select("dataset_id", "location", "format", "columns").collect():
        kinds.setdefault((r["format"], tuple(r["columns"])), []).append(r)
    out = []
    for (fmt, columns), rows in sorted(kinds.items()):
        paths = [r["location"] for r in rows]
        if fmt == "csv":
            raw = (spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", "true")
                   .option("enforceSchema", "false").csv(paths))
        else:
            raw = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
        path = plain_path(F.col("_metadata.file_path"))
        raw = raw.select(*[F.col(f"`{c}`") for c in columns], path.alias("_file"))
        places = spark.createDataFrame([(r["dataset_id"], r["location"]) for r in rows], "_id string, _loc string").select(
            F.col("_id"), F.regexp_replace("_loc", r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "").alias("_loc"))
        # a dataset is a file, or a folder of files: its rows have its path or lie one level below it
        at = F.when(F.lower("_file").rlike(r"/part-[^/]*$"), F.regexp_replace("_file", r"/[^/]*$", "")).otherwise(F.col("_file"))
        data = raw.withColumn("_loc", at).join(places, "_loc")
        if fmt == "csv":
            text = na_to_null(data.select(*[F.col(f"`{c}`") for c in columns], "_id"))
            types = infer_types(text.drop("_id"))
            data = text.select("_id", *[F.expr(f"try_cast(`{c}` AS {t})").alias(c) if t else F.col(f"`{c}`") for c, t in types.items()])
        else:
            data = data.select("_id", *[F.col(f"`{c}`") for c in columns])
        out.append((list(columns), nan_to_null(data)))
    return out


def read_owned(spark: SparkSession, registry: DataFrame, dataset_id: str, user_id: int) -> DataFrame:
    """One dataset of ``user_id``'s; an error if there's none, or if it is another's."""
    found = read_registered(spark, owned_by(registry, user_id).filter(F.col("dataset_id") == F.lit(dataset_id)))
    if not found:
        raise LookupError(f"user {user_id} has no dataset {dataset_id}")
    return found[0][1].drop("_id")


def profile(columns: list[str], data: DataFrame, target: str | None = None) -> DataFrame:
    """S3 over many datasets: per dataset rows, columns, target, features, missing cells and the target's total (null for text)."""
    tgt, features = column_roles(data.drop("_id"), target)
    num = dict(data.dtypes)[tgt] not in ("string", "boolean", "timestamp", "date")
    return data.groupBy(F.col("_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(columns)).alias("col_count"), F.lit(tgt).alias("target"),
        F.lit(",".join(features)).alias("features"),
        sum((F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in columns), F.lit(0)).cast("long").alias("null_count"),
        (F.sum(F.col(f"`{tgt}`").cast("double")) if num else F.lit(None).cast("double")).alias("target_total"))
