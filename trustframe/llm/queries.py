"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from trustframe.llm import classifier, decontaminate, lexical, lines, mixing, neardup, negatives, quality, secrets, sharding, substrings, toxicity, warc  # noqa: F401
from trustframe.llm.common import ORACLE, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["QUERIES", "ORACLE"]
