"""Secret scans with corpus-wide ownership frequency (operator 10).

One pass finds the candidates of each document: the base kinds (assignments, access keys, hex
strings) and tokens that look random (``token``: 24 characters or more of three character classes
and high entropy).  Only their hashes leave the pass.  Each value's hash is summed over the
corpus by distinct owners and repositories, in two steps, so that a value which a third of all
documents hold is reduced inside each task.  A value that many owners or repositories hold, or
that is copied very often, is an example (``widely copied``); another that only one owner holds,
and looks random, is live.  Base candidates
all stay; a token that overlaps no base span is added unless it is an example (one that two owners
hold is unclear and stays).

Here the owner is ``source`` and the repository (source, lang), both parameters.  Defined
results: null text is empty; a null owner or repository counts as one of its own; repeated rows
are rows of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import kernels as K
from trustframe.llm.common import cut, map_arrow, register, table

# The base patterns, in their order, and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of [0-9a-f]+ of 16 or more
KINDS = ["assign", "access", "hex", "token"]

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    classes = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit))
    return classes == 3 and entropy(value) >= 3.5


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the text, by start and then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = [(a, b) for a, _, b, _ in out]
    for m in TOKEN.finditer(text):
        if looks_random(m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())]))


def _scan(batch):
    for part in K.slices(batch, 0):
        found = [[{"start": a, "kind": k, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "random": looks_random(v) or k == 1 or (k == 2 and entropy(v) >= 3)}
                  for a, k, b, v in candidates(text)] if text else [] for text in part.column(0).to_pylist()]
        yield [*part.columns[1:], pa.array(found, _FOUND)]


@dataclass
class SecretScan:
    owner: str = "source"
    repository: tuple = ("source", "lang")
    # owners, repositories or copies from which on a value counts as an example
    copied_owners: int = 3
    copied_repositories: int = 3
    copied_copies: int = 100

    def found(self, docs: DataFrame) -> DataFrame:
        """row, doc_id, owner, repository and the candidates of each row."""
        repo = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(self.repository)]))
        cols = ["text", F.monotonically_increasing_id().alias("row"), "doc_id", F.col(self.owner).cast("string").alias("owner"), repo.alias("repo")]
        return map_arrow(docs, cols, _scan, "row long, doc_id long, owner string, repo string, "
                         "found array<struct<start:int,kind:int,end:int,value:binary,random:boolean>>")

    @staticmethod
    def ownership(found: DataFrame) -> DataFrame:
        """(value, owners, repositories, copies) of every candidate value."""
        each = found.select(F.explode("found.value").alias("value"), F.coalesce(F.concat(F.lit("o"), "owner"), F.lit("")).alias("owner"), "repo")
        pairs = each.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
        owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))  # a repository has one owner
        return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"), F.sum("n").alias("copies"))

    def scan(self, docs: DataFrame) -> DataFrame:
        """doc_id and spans (kind, start, end, owners, repositories, verdict) of each row."""
        found = cut(self.found(docs))
        own = self.ownership(found)
        each = found.select("row", F.explode("found").alias("c")).select("row", "c.*").join(own, "value")
        copied = ((F.col("owners") >= self.copied_owners) | (F.col("repositories") >= self.copied_repositories)
                  | (F.col("copies") >= self.copied_copies))
        verdict = (F.when(copied, "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("unclear"))
        name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
        each = each.withColumn("verdict", verdict).filter((F.col("kind") < 3) | (F.col("verdict") != "example"))
        spans = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("rank"), "end", name.alias("kind"), "owners", "repositories", "verdict"))).alias("spans"))
        return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


@register("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, with the live-looking and the widely copied ones counted."""
    got = SecretScan().scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k).alias(f"n_{k}")
    return got.select(
        "doc_id", *[of_kind(k) for k in KINDS[:3]],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "token")).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"))
