"""The corpus pipeline: documents in, shards of a mixed training set out.

Each stage works on all rows that the one before kept; its result is written as Parquet in the
shared folder and read again, which also cuts the lineage, so a lost executor costs a stage's
tasks at most.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustframe.llm.common import folder, table
from trustframe.llm.decontaminate import Decontaminator
from trustframe.llm.mixing import PoissonMix
from trustframe.llm.neardup import MinHashDedup
from trustframe.llm.sharding import Sharding
from trustframe.llm.toxicity import ToxicPassages


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of toxic passages doesn't reject."""
    return ToxicPassages().clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group: 5-word shingles, similarity of 80 % or more."""
    return MinHashDedup(words=5, percent=80).dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return Decontaminator(words=5, percent=80).clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at shares of bytes ** 0.7, each document as often as its Poisson draw, shuffled."""
    return PoissonMix(power=0.7).mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with shard (0 to 39, of near equal bytes) and slot."""
    return Sharding(shards=40).shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: MinHash, segment scores and differencing have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
