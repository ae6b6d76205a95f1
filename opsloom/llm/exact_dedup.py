"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of ``CHUNK`` bytes. One matrix product gives every chunk's
polynomial hash under four (prime, base) pairs; the hashes of neighbouring chunks combine by
``hash(AB) = hash(A) * base^len(B) + hash(B)``, so a huge document is cut into parts that are
hashed by different tasks and put together afterwards, in order. Texts with equal fingerprints
and lengths are then compared with their group's first text, in one pass that ends at the
first difference; a text that differs (a collision) goes into a group of its own content.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from opsloom.llm.common import only_keys, row_key, whole_text, written

CHUNK = 4096
# Primes below 2^31 keep chunk sums exact in doubles: 4096 * 255 * 2^31 < 2^53.
FIELDS = ((2147483647, 1103515245), (2147483629, 69069001), (2147483587, 16807), (2147483579, 48271))
SPACES = b" \t\n\x0b\x0c\r"
# Bytes beyond which a document is cut into parts of that size.
PART = 1 << 20


@lru_cache(maxsize=1)
def chunk_weights() -> np.ndarray:
    """Column f, row i: base_f^(CHUNK-1-i) mod prime_f."""
    out = np.empty((CHUNK, len(FIELDS)))
    for f, (prime, base) in enumerate(FIELDS):
        power = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, f] = power
            power = power * base % prime
    return out


def chunk_hashes(data: bytes) -> list[tuple[tuple[int, ...], int]]:
    """(hash, length) of each chunk of ``data``, in order. Bytes count from 1, so zeros matter."""
    weights = chunk_weights()
    values = np.frombuffer(data, np.uint8).astype(np.float64) + 1
    full = len(values) // CHUNK
    primes = np.array([p for p, _ in FIELDS], dtype=np.float64)
    found = []
    if full:
        sums = np.mod(values[: full * CHUNK].reshape(full, CHUNK) @ weights, primes)
        found = [(tuple(int(x) for x in row), CHUNK) for row in sums]
    rest = values[full * CHUNK :]
    if len(rest):
        row = np.mod(rest @ weights[CHUNK - len(rest) :], primes)
        found.append((tuple(int(x) for x in row), len(rest)))
    return found


def combine(left: tuple[tuple[int, ...], int], right: tuple[tuple[int, ...], int]):
    """Fingerprint of the concatenation from the fingerprints of its parts."""
    hashes = tuple(
        (a * pow(base, right[1], prime) + b) % prime
        for a, b, (prime, base) in zip(left[0], right[0], FIELDS, strict=True)
    )
    return hashes, left[1] + right[1]


def whole(data: bytes) -> tuple[tuple[int, ...], int]:
    """(hash, length) of a byte string, from its chunks."""
    total = NOTHING
    for start in range(0, len(data), CHUNK * 256):
        for chunk in chunk_hashes(data[start : start + CHUNK * 256]):
            total = combine(total, chunk)
    return total


NOTHING = ((0,) * len(FIELDS), 0)


def written_out(total: tuple[tuple[int, ...], int]) -> str:
    return "".join(f"{h:08x}" for h in total[0]) + f"{total[1]:x}"


def read_back(text: str) -> tuple[tuple[int, ...], int]:
    digits = 8 * len(FIELDS)
    return tuple(int(text[i : i + 8], 16) for i in range(0, digits, 8)), int(text[digits:], 16)


def fingerprint(data: bytes) -> str:
    """Hexadecimal fingerprint of a byte string; its length is part of it."""
    return written_out(whole(data))


@F.pandas_udf(StringType())
def part_fingerprint(part: pd.Series) -> pd.Series:
    return part.map(fingerprint)


@F.pandas_udf(StringType())
def combined_fingerprint(parts: pd.Series) -> pd.Series:
    """The fingerprint of the whole from those of its parts in order."""
    return parts.map(lambda found: written_out(reduce(combine, map(read_back, found), NOTHING)))


@F.pandas_udf(StringType())
def text_fingerprint(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fingerprint((t or "").encode().translate(None, SPACES)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key, print, points, text_sha256 of each row; huge texts are hashed in parts.

    A part is at most ``PART`` bytes of the compared form, a row of its own, so that the parts
    of one document are spread over tasks. What a group collects are fingerprints of parts.
    """
    rows = docs.select(
        "doc_id",
        row_key().alias("key"),
        "text",
        F.length(whole_text()).cast("long").alias("points"),
        F.sha2(stripped(), 256).alias("text_sha256"),
    )
    huge = F.octet_length(whole_text()) > PART
    shown = ["doc_id", "key", "points", "text_sha256"]
    plain = rows.where(~huge).select(*shown, text_fingerprint("text").alias("print"))
    # Through a generator, so that the text is cleaned once and not for every part.
    body = rows.where(huge).select("key", F.explode(F.array(stripped().cast("binary"))).alias("body"))
    count = F.greatest(F.ceil(F.octet_length("body") / PART), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("body", i * PART + 1, F.lit(PART)))
    parts = body.dropDuplicates(["key"]).select("key", F.posexplode(cut).alias("no", "part"))
    hashed = parts.repartition("key", "no").select("key", "no", part_fingerprint("part").alias("print"))
    joined = hashed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "print"))).alias("parts"))
    prints = joined.select("key", combined_fingerprint(F.transform("parts", lambda p: p["print"])).alias("print"))
    large = rows.where(huge).select(*shown).join(prints.hint("merge"), "key").select(*shown, "print")
    return plain.unionByName(large)


def stripped():
    """The compared form: the text without ASCII white space."""
    return F.translate(whole_text(), " \t\n\x0b\x0c\r", "")


def dedup_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the one with the most code points (white space counts there), then the
    smallest doc_id stays; a null doc_id comes last. Rows that repeat doc_id and text share
    one decision: all say ``kept`` or none. Null texts are empty; all empty or blank texts
    are one group. An empty table gives no rows. Other columns are ignored.
    """
    slim = written(fingerprints(docs), "dedup-prints")
    part = F.coalesce("part", F.lit(""))
    split = slim.join(different(docs, slim), "key", "left").withColumn("part", part)
    rank = F.struct("points", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    groups = written(
        split.groupBy("print", "part").agg(
            F.max_by("doc_id", rank).alias("keep_id"),
            F.max("points").alias("most"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "dedup-groups",
    )
    is_best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    return split.join(groups, ["print", "part"]).select(
        "doc_id", "keep_id", "group_size", is_best.alias("kept"), "text_sha256", "key"
    )


def different(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """(key, part) of rows whose text is not that of their fingerprint's first row.

    Every row of a repeated fingerprint is compared with that row's text; ``part``
    is the digest of the differing text, so that such texts are grouped among themselves.
    """
    repeated = written(
        slim.groupBy("print")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first"))
        .where("rows > 1")
        .select("print", "first"),
        "dedup-repeated",
    )
    members = written(
        slim.join(repeated, "print").select("key", "print", "first", "text_sha256").distinct(),
        "dedup-members",
    )
    texts = docs.select(row_key().alias("key"), stripped().alias("body"))
    # Rows with one key have one text, so a single row stands for them. The merge join is asked
    # for so that the plan is the same at every size.
    bodies = written(
        texts.join(members.hint("merge"), "key").dropDuplicates(["key"]), "dedup-bodies"
    )
    first = bodies.where("key = first").select("print", F.col("body").alias("first_body"))
    return (
        bodies.join(first, "print")
        .where("body <> first_body")
        .select("key", F.col("text_sha256").alias("part"))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a repeated row stays once."""
    keys = dedup_groups(docs).where("kept").select("key").distinct()
    return only_keys(docs, keys)
