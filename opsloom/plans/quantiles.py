"""Exact interpolated quantiles per key without holding a key's values in one task.

Spark's ``percentile`` keeps a value -> count map per group, which is fine while the input
is small and impossible when one group holds a third of a huge table. The large form is a
radix selection: a double is mapped to a 64-bit integer of the same order, and four rounds
count its bits 16 at a time. A round counts, per key, only the values that agree with a wanted
rank in all bits so far; counts are combined before they travel, and a key has at most
65,536 of them for each wanted prefix, however many rows it holds. After the last round the
integer, and so the value, is known exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.plans.durable import durable
from opsloom.plans.joins import match
from opsloom.plans.sizing import fits_one_task, small_side

# Bits below the part of the integer that a round looks at.
SHIFTS = (48, 32, 16, 0)
FRACTION_BITS, EXPONENT_BIAS = 52, 1023
# The smallest positive double, and the integers of the first normal one, infinity and NaN.
LEAST = 5e-324
FIRST_NORMAL = 1 << FRACTION_BITS
INFINITE = 2047 << FRACTION_BITS


def ordered_integer(value: Column) -> Column:
    """A long with the order of the double: exponent and fraction, negated for negative values.

    Zeros are one value, and NaN is above infinity, as Spark sorts them.
    """
    size = F.abs(value)
    rough = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), rough)
    # The logarithm may be off by one next to a power of two.
    exponent = F.when(size < power, rough - 1).when(size >= 2.0 * power, rough + 1).otherwise(rough)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1.0) * float(FIRST_NORMAL)
    normal = (exponent + EXPONENT_BIAS).cast("long") * F.lit(FIRST_NORMAL) + fraction.cast("long")
    bits = (
        F.when(size == 0.0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit(INFINITE))
        .when(size < 2.0 ** (1 - EXPONENT_BIAS), (size / LEAST).cast("long"))
        .otherwise(normal)
    )
    return F.when(F.isnan(value), F.lit(INFINITE + 1)).otherwise(F.when(value < 0, -bits).otherwise(bits))


def integer_value(bits: Column) -> Column:
    """The double of an ``ordered_integer``."""
    size = F.abs(bits)
    exponent = F.shiftright(size, FRACTION_BITS) - EXPONENT_BIAS
    fraction = size.bitwiseAND(F.lit(FIRST_NORMAL - 1)) / float(FIRST_NORMAL)
    found = (
        F.when(size > INFINITE, float("nan"))
        .when(size == INFINITE, float("inf"))
        .when(size < FIRST_NORMAL, size * LEAST)
        .otherwise((1.0 + fraction) * F.pow(F.lit(2.0), exponent))
    )
    return F.when(bits < 0, -found).otherwise(found)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    split: bool | None = None,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles named ``names``."""
    keys = list(keys)
    source = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if split is None:
        split = not fits_one_task(source)
    if not split:
        grouped = source.groupBy(*keys).agg(
            F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q")
        )
        return grouped.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    rows = source.select(*keys, ordered_integer(F.col("_v")).alias("_bits"))
    cells = durable(cell_counts(rows, keys, SHIFTS[0]))
    sizes = cells.groupBy(*keys).agg(F.sum("_rows").alias("_n"))
    wanted = wanted_ranks(sizes, keys, probs)
    for at, shift in enumerate(SHIFTS):
        if at:
            # All later rounds look only at values that share their first bits with a wanted one.
            rows = rows.withColumn("_prefix", F.shiftright("_bits", SHIFTS[at - 1]))
            prefixes = small_side(wanted.select(*keys, "_prefix").distinct())
            rows = match(rows, prefixes, [*keys, "_prefix"], "left_semi")
            if at == 1:
                rows = durable(rows)
            cells = durable(cell_counts(rows, keys, shift))
        wanted = durable(narrowed(wanted, cells, keys, first=at == 0))
    found = [F.max(F.when(F.col("_slot") == s, F.col("_prefix"))).alias(f"_s{s}") for s in range(2 * len(probs))]
    out = wanted.groupBy(*keys).agg(*found, F.max("_n").alias("_n"))
    for i, (p, n) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = integer_value(F.col(f"_s{2 * i}")), integer_value(F.col(f"_s{2 * i + 1}"))
        out = out.withColumn(n, F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos))))
    return out.select(*keys, *names)


def cell_counts(rows: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """keys, _cell (the bits from ``shift`` on), _rows."""
    cell = F.shiftright("_bits", shift).alias("_cell")
    return rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_rows"))


def wanted_ranks(sizes: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """keys, _n, _slot, _rank: the two ranks from 0 that each quantile lies between."""
    slots = []
    for i, p in enumerate(probs):
        low = F.floor(F.lit(float(p)) * (F.col("_n") - 1))
        slots.append(F.struct(F.lit(2 * i).alias("_slot"), low.alias("_rank")))
        slots.append(F.struct(F.lit(2 * i + 1).alias("_slot"), F.least(low + 1, F.col("_n") - 1).alias("_rank")))
    return sizes.select(*keys, "_n", F.inline(F.array(*slots)))


def narrowed(wanted: DataFrame, cells: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """The wanted ranks with the cell that holds them as prefix, counted from that cell's first value."""
    parent = F.lit(0).cast("long") if first else F.shiftright("_cell", 16)
    cells = cells.withColumn("_prefix", parent)
    if first:
        wanted = wanted.withColumn("_prefix", parent)
    upto = W.partitionBy(*keys, "_prefix").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    placed = cells.withColumn("_end", F.sum("_rows").over(upto))
    start = F.col("_end") - F.col("_rows")
    return (
        match(wanted, placed, [*keys, "_prefix"])
        .where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end")))
        .select(*keys, "_n", "_slot", (F.col("_rank") - start).alias("_rank"), F.col("_cell").alias("_prefix"))
    )
