"""Hash-derived keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_modulo(text: Column, n: int) -> Column:
    """The 128-bit MD5 of ``text`` as a number, modulo ``n``, folded 16 bits at a time."""
    digest = F.md5(text)
    words = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"),
    )
    return F.aggregate(
        words, F.lit(0).cast("bigint"), lambda acc, w: (acc * 65536 + w) % F.lit(n)
    ).cast("int")


def short_id(prefix: str, *parts: Column, length: int = 8) -> Column:
    """A stable identifier: the first hex digits of a SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)))
