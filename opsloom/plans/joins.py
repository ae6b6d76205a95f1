"""Joins whose keys may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys where null equals null, as grouping treats it; the left's keys stay."""
    others = [c for c in right.columns if c not in keys]
    right = right.select(*[F.col(k).alias(f"_match_{k}") for k in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_match_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_match_{k}" for k in keys])
