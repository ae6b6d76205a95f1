"""Evaluating an expensive expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` through a one-element generator.

    A filter on a projected column is pushed below the projection and evaluates the whole
    expression again for every mention; it is not pushed below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
