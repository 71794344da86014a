"""Values of JSON documents by path, over VARIANT: a document is parsed once, whatever the number of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The document as a variant; null for text that is no JSON."""
    return F.try_parse_json(text)


def first_of(document: Column, paths: list[str], kind: str = "string", default=None) -> Column:
    """The value of the first path that leads to one of the kind, else the default."""
    found = [F.try_variant_get(document, p, kind) for p in paths]
    return F.coalesce(*found, *([] if default is None else [F.lit(default)]))


def which(document: Column, paths: list[str], kind: str = "string") -> Column:
    """The number (from 1) of that path; 0 without one."""
    out = F.lit(0)
    for i in reversed(range(len(paths))):
        out = F.when(F.try_variant_get(document, paths[i], kind).isNotNull(), i + 1).otherwise(out)
    return out
