"""Rounding that does not depend on the order in which a sum was formed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(value: Column, digits: int) -> Column:
    """Half-up rounding after dropping noise below 1e-9, so a tie stays a tie in any plan."""
    return F.round(F.round(value, 9), digits)


def exact_round(value: Column, digits: int) -> Column:
    """Rounds a share in [0, 1] by its exact binary value, ties to even.

    The double is scaled to the integer it is a multiple of and compared with the tie in
    decimal arithmetic, so 0.7875, which is a little less in binary, becomes 0.787.
    """
    one = 2**62
    scale = 10**digits
    below = F.floor(value * scale).cast("decimal(19,0)")
    # By way of bigint: a double becomes a decimal through its shortest text, which is inexact.
    exact = (value * float(one)).cast("bigint").cast("decimal(19,0)") * F.lit(2 * scale)
    tie = (below * 2 + 1).cast("decimal(12,0)") * F.lit(one).cast("decimal(19,0)")
    up = (exact > tie) | ((exact == tie) & (below % 2 == 1))
    return (below + F.when(up, 1).otherwise(0)).cast("double") / float(scale)


def printed(value: Column, digits: int) -> Column:
    """The number as C's ``%.nf`` prints it: rounded by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal text half-up instead: 119.55, a little less in
    binary, reads 119.6 there and 119.5 here. Beyond 2^63 a double has no fraction to round.
    """
    size = F.abs(value)
    whole = F.floor(size)
    rounded = exact_round(size - whole, digits).cast(f"decimal(20,{digits})")
    text = (whole.cast("decimal(20,0)") + rounded).cast(f"decimal(22,{digits})").cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(size < float(2**63), F.concat(sign, text)).otherwise(
        F.format_string(f"%.{digits}f", value)
    )
