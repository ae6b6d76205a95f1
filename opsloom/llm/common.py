"""What several corpus operators share: reading, written intermediates, column shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.plans.durable import stored
from opsloom.session import ship_package

# Characters between words: ASCII white space, written as ranges for both regex dialects.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: computed once, read many times."""
    return stored(df, name, "zstd")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def digest_key(*columns: Column) -> Column:
    """128 bits of the columns' values, nulls apart from all values: no two of 10^15 rows share one by chance."""
    parts = [
        F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c.cast("string")))
        for c in (c.cast("string") for c in columns)
    ]
    return F.unhex(F.md5(F.concat(*parts)))


def row_key() -> Column:
    """One key per distinct (doc_id, text): rows that repeat both are interchangeable."""
    return digest_key(F.col("doc_id"), F.col("text"))


def only_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``keys`` (distinct ``key``), one row per key."""
    rows = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(keys, "key").dropDuplicates(["key"]).select("row.*")
