"""Guarded reads of nested JSON text: a value counts only if the document parses, every step of the
path is an object with that key, and the value has the type asked for; else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(doc: Column, path: tuple[str, ...]) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), "$" + "".join(f"['{p}']" for p in path), "variant")


def json_text(doc: Column, *path: str) -> Column:
    """The string at a path."""
    at = _at(doc, path)
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def json_number(doc: Column, *path: str) -> Column:
    """The number at a path, as a double."""
    at = _at(doc, path)
    return F.when(F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(at, "$", "double"))


def json_kind(doc: Column) -> Column:
    """What the whole document is: object, array, scalar, or null if it is malformed or missing."""
    shape = F.schema_of_variant(F.try_parse_json(doc))
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape.isNotNull(), "scalar")
