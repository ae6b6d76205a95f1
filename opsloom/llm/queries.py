"""The corpus queries over the given tables and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import (
    checks,
    divergence,
    exact_dedup,
    mixing,
    pieces,
    prefix_prints,
    quality,
    resampling,
    resharding,
    secret_scan,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
)
from opsloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(read(spark, sf_dir, "documents")).drop("kept")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"))


@query("op3_resharding")
def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards by source, which are very unequal, to 24 of equal bytes."""
    old = F.pmod(F.xxhash64("source"), F.lit(resharding.SHARDS))
    rows = resharding.resharded(read(spark, sf_dir, "documents"), old)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents")).drop("key")


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_prints.fingerprinted(read(spark, sf_dir, "documents"))


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(read(spark, sf_dir, "documents"))


@query("op7_mixing", checks.MIXING)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_exact_dedup", checks.EXACT_DEDUP)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(read(spark, sf_dir, "documents")).drop("key")


@query("op11_source_divergence", checks.DIVERGENCE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(read(spark, sf_dir, "documents"))


@query("op12_url_filters")
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels URLs: the trees learn from the URLs that a rule decides."""
    return url_filter.judged(read(spark, sf_dir, "pages"))


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
