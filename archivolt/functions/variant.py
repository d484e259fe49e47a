"""Documents' metadata as VARIANT: typed paths, and what is left without the heavy keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """JSON text as a variant; null for text that is no JSON."""
    return F.try_parse_json(c)


def path(v: str, at: str, kind: str) -> Column:
    """The value at a path as a type; null where the path or such a value is missing."""
    return F.try_variant_get(F.col(v), at, kind)


def light(v: str, *heavy: str) -> Column:
    """A variant object without some keys, as JSON text; null if nothing is left."""
    names = ", ".join(f"'{k}'" for k in heavy)
    left = f"map_filter(try_variant_get({v}, '$', 'map<string, variant>'), (k, x) -> k NOT IN ({names}))"
    return F.expr(f"CASE WHEN size({left}) > 0 THEN to_json({left}) END")
