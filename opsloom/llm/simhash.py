"""SimHash near-duplicate groups found through deletion variants of fingerprint halves.

Two fingerprints that differ in at most two bits differ in at most one bit in one of their
halves. Each half is indexed with one bit removed, once for each of its bits; fingerprints
that share such a variant meet in an equality join and their full distance is verified.
Where many fingerprints share a variant, the pairs among them are not written out: each of
them is spread over the 65 values within one bit of it, and two of them are within two bits
of each other exactly if they share such a value. At most 65 fingerprints can share one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from opsloom.llm.common import only_keys, row_key, written
from opsloom.llm.components import star_forest

SEED = 42
SHINGLE_WORDS = 3
# Fingerprints that may meet in one variant before the spread takes over from pairs.
PAIRED = 8
# Shingles hashed at a time, so that memory does not grow with the text.
BLOCK = 16384
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(words, len(parts))
    starts, ends = starts[: len(parts) - size + 1], ends[size - 1 :]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        block = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        counts += bit_counts(np.array([hashed(joined[a:b], SEED) for a, b in block], np.uint64))
    return fingerprint(counts, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set, the highest bit first."""
    bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int32)


def fingerprint(counts: np.ndarray, n: int) -> int:
    """The unsigned fingerprint of ``n`` hashes: the bits that over half of them have."""
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def text_simhash(text: pd.Series) -> pd.Series:
    values = np.fromiter((simhash(t) for t in text), np.uint64, len(text))
    return pd.Series(values.view(np.int64))


def bit_count_between(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def variants(prints: DataFrame) -> DataFrame:
    """(half, bit, rest, print): each half of each fingerprint without one of its bits."""
    spread = prints.select(
        "print",
        F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"),
    )
    mask = F.when(F.col("bit") < 32, F.lit(0xFFFFFFFF)).otherwise(F.lit(-(1 << 32)))
    rest = F.expr("print & ~shiftleft(1L, bit)").bitwiseAND(mask)
    return spread.select("print", "bit", rest.alias("rest"))


def close_pairs(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (distinct ``print``) within two bits of each other."""
    index = variants(prints)
    shared = written(
        index.groupBy("bit", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "variants"
    )
    # A merge join at every size: the plan, and so the growth, does not change with the input.
    met = written(index.join(shared.hint("merge"), ["bit", "rest"]), "met")
    few = met.where(F.col("n") <= PAIRED)
    other = few.select("bit", "rest", F.col("print").alias("b"))
    paired = (
        few.withColumnRenamed("print", "a")
        .join(other, ["bit", "rest"])
        .where("a < b")
        .where(bit_count_between("a", "b") <= 2)
        .select("a", "b")
        .distinct()
    )
    many = met.where(F.col("n") > PAIRED).select("print").distinct()
    near = F.expr("concat(array(print), transform(sequence(0, 63), i -> print ^ shiftleft(1L, i)))")
    stars = (
        many.select("print", F.explode(near).alias("middle"))
        .groupBy("middle")
        .agg(F.collect_list("print").alias("prints"))
        .where("size(prints) > 1")
        .select(F.array_min("prints").alias("a"), F.explode("prints").alias("b"))
        .where("a <> b")
        .distinct()
    )
    return paired.unionByName(stars)


def rooted_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, print, root, component_id: one row per row of ``docs``; a root is one component."""
    slim = written(
        docs.select("doc_id", row_key().alias("key"), text_simhash("text").alias("print")), "simhashes"
    )
    prints = written(slim.groupBy("print").agg(F.min("doc_id").alias("least_id")), "prints")
    forest = star_forest(close_pairs(prints.select("print")))
    rooted = prints.join(forest, F.col("print") == F.col("node"), "left").select(
        "print", "least_id", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("print", "root", "component_id"), "components")
    return slim.join(named, "print")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, key: one row per row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other. component_id is
    the smallest doc_id that links lead to; null ids count only where a component has no
    other. Repeated rows get equal results; an empty table gives none. Other columns are ignored.
    """
    return rooted_rows(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        "key",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the row with the smallest doc_id, whole.

    A group is a component, not its component_id: ids can be null or stand in several components.
    """
    least = F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    keys = rooted_rows(docs).groupBy("root").agg(least.alias("key")).select("key")
    return only_keys(docs, keys)
