"""Exact per-key row numbers that never put a whole key into one task.

``row_number() over (partition by key ...)`` sorts all rows of a key in a single task. When
one key holds a third of the table that task never ends, so beyond a size check the rank is
built from two bounded pieces: how many rows of the key lie in earlier slices, and the
position inside the slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.plans.durable import durable
from opsloom.plans.sizing import fits_one_task

# Rows of one key that a single task sorts.
SLICE_ROWS = 1_000_000


def _joined_rank(df: DataFrame, keys: Sequence[str], order: list[Column], out: str) -> DataFrame:
    """Rank from slice sizes (column ``_slice`` is monotone in the order) plus inner position."""
    sizes = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    inner = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        df.withColumn("_inner", inner)
        .join(starts, same)
        .withColumn(out, (F.col("_before") + F.col("_inner")).cast("bigint"))
        .drop("_slice", "_inner", "_before", "_k_slice", *[f"_k_{k}" for k in keys])
    )


def arrival_rank(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    out: str,
    slice_rows: int = SLICE_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """1-based position per key in arrival order, for a unique integer ``seq``.

    Ids may be dense, sparse or clustered: beyond a size check rows are cut at sampled ranges
    of (key, seq), about ``slice_rows`` to a slice.
    """
    if split is None:
        split = not fits_one_task(df)
    if not split:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(seq))
        return df.withColumn(out, rank.cast("bigint"))
    slices = max(2, -(-df.count() // slice_rows))
    return ordered_rank(df, keys, [F.col(seq)], out, split=True, slices=slices)


def ordered_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    split: bool | None = None,
    slices: int | None = None,
) -> DataFrame:
    """1-based position per key for any total order.

    The large form range-partitions by (keys, order), which cuts a hot key into many
    slices, and writes the result down first: slice numbers come from sampled bounds, so
    they must be frozen before two branches of the plan read them.
    """
    order = list(order)
    if split is None:
        split = not fits_one_task(df)
    if not split:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, rank.cast("bigint"))
    if slices is None:
        slices = max(2, -(-df.count() // SLICE_ROWS))
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    frozen = durable(ranged.withColumn("_slice", F.spark_partition_id()))
    return _joined_rank(frozen, keys, order, out)
