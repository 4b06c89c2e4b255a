"""What the operators share: the shared folder, lineage cuts, registration, small table helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trustframe.session import checkpoint_dir
from trustframe.sources.tables import table

__all__ = ["QUERIES", "ORACLE", "register", "table", "cut", "folder", "fresh", "map_arrow"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: computed once, kept if
    executors go, with sizes that the planner knows.  The table goes when the session ends."""
    spark = df.sparkSession
    path = folder(spark, "cut")
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table or files that an operator writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB where the session has the default of 64: a worker holds one at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, "4m")


def map_arrow(df: DataFrame, columns: list, fn: Callable[[pa.RecordBatch], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """mapInArrow over the given columns; ``fn`` takes a batch and yields lists of columns."""
    names = StructType.fromDDL(schema).names
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*columns).mapInArrow(run, schema)
