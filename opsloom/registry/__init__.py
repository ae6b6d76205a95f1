"""Queries over the given tables, each with the SQL its result is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsloom.session import ship_package
from opsloom.sources.tables import check_sql, domain_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def rounded(sql: str, digits: int) -> str:
    """Check-side rounding that agrees with the library's on ties."""
    return f"cast(round(cast({sql} as decimal(28, 9)), {digits}) as double)"


def exactly_rounded(sql: str) -> str:
    """Check-side rounding of a share to three digits by its binary value, ties to even."""
    part = f"cast(floor(({sql}) * 1000) as hugeint)"
    over = f"(cast(({sql}) * 4611686018427387904::double as hugeint) * 2000 - (2 * {part} + 1) * 4611686018427387904::hugeint)"
    return f"(({part} + case when {over} > 0 or ({over} = 0 and {part} % 2 = 1) then 1 else 0 end)::double / 1000)"


class Views:
    """Attribute access to base tables and derived views of one data folder.

    Each relation is resolved once per query; they are lazy plans, nothing is cached.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self._plans: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return domain_view(self.spark, self.sf_dir, name, self._plans)


def query(name: str, sql: str | None = None):
    """Registers ``fn(views) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return fn

    return add


def load_all() -> None:
    from opsloom.registry import (  # noqa: F401
        pipeline,
        anomaly,
        http,
        safety,
        retrieval,
        topology,
        response,
        evaluation,
    )
