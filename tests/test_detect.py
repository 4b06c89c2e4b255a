"""Attribute detection counts only columns that may qualify."""
from pyspark.sql import functions as F

from trustframe.operators.fairness import detect_sensitive_attributes


def test_detection_by_name_and_number_of_values(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3000).cast("string").alias("gender"), (F.col("id") % 10).cast("string").alias("ten"), (F.col("id") % 11).cast("string").alias("eleven"),
        (F.col("id") % 5).cast("double").alias("five"), (F.col("id") % 6).alias("six"), (F.col("id") % 2 == 0).alias("flag"), F.lit(1).alias("one"),
        F.col("id").cast("string").alias("many"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.lit(-0.0)).alias("zeros"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 2).alias("with nan"), F.current_date().alias("day"))
    got = {r["column"]: (r["reason"], r["n_unique"]) for r in detect_sensitive_attributes(df, ["six"]).collect()}
    assert got == {"gender": ("name", 3000), "ten": ("categorical", 10), "five": ("numeric", 5), "flag": ("numeric", 2), "with nan": ("numeric", 3)}
    assert detect_sensitive_attributes(df.select("many", "day")).count() == 0
    assert detect_sensitive_attributes(df.select("ten").limit(0)).count() == 0
