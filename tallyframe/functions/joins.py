"""Joins over keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys of which two nulls are equal; the keys are those of left. Still a hash or merge join."""
    names = {k: f"__right_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())
