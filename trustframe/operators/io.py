"""Preview, fingerprint, content hash and result export.

The fingerprint checksum is order-insensitive (a sum of per-row hashes), so
it is one aggregation with partial sums and does not depend on file order or
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.expr import count_if


def _text(f: T.StructField) -> F.Column:
    """A cell as text, without loss: its length and the text of the value, or a null mark."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        c = c.cast("string")
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def fingerprint(df: DataFrame) -> DataFrame:
    """row/column counts, sorted column list, column types, null cells, checksum.

    A row's text gives each cell with its length, or a mark for null, so different rows have
    different texts; its hash is 60 bits of MD5.  The checksum is the exact decimal sum of the
    hashes and their exclusive or: independent of order, and without overflow."""
    cols = sorted(df.columns)
    row_hash = F.conv(F.substring(F.md5(F.concat_ws("|", *[_text(f) for f in df.schema.fields])), 1, 15),
                      16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("col_count"),
        F.lit(",".join(cols)).alias("columns"),
        F.lit(",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols)).alias("dtypes"),
        sum((count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).cast("long").alias("null_count"),
        F.coalesce(F.sum(row_hash.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"),
        F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("checksum_xor"))


def dtypes_map(df: DataFrame) -> dict[str, str]:
    """The fingerprint's dtype map (schema metadata, no job)."""
    return dict(df.dtypes)


def preview(df: DataFrame, order: list[str], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows by ``order``; and a table with one row per column: name, type, nulls
    among the previewed rows, and the whole table's row and column counts."""
    head = df.orderBy(*order).limit(n)
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                               F.col(f"`{c}`").isNull().cast("long").alias("nul")) for i, (c, t) in enumerate(df.dtypes)])
    stats = (head.select(F.explode(cells).alias("x")).groupBy("x.ord", "x.column", "x.dtype").agg(F.sum("x.nul").alias("preview_nulls")))
    total = df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)))
    return head, stats.withColumn("_j", F.lit(1)).join(F.broadcast(total.withColumn("_j", F.lit(1))), "_j").drop("_j")


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes (binaryFile source; one row per file)."""
    return (spark.read.format("binaryFile").load(path)
                 .select("path", "length", F.sha2(F.col("content"), 256).alias("file_hash")))


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write results (parquet or CSV with header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)
