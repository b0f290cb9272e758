"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without any white space (also Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    """Without white space at the ends and in lower case: the key of values that differ only in those."""
    return F.lower(stripped(c))


def canonical_json(c: Column) -> Column:
    """A JSON value's canonical text (keys sorted, no layout); text that isn't JSON stays as it is, stripped."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), stripped(c))
