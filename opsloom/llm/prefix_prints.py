"""Document fingerprints from prefix polynomial hashes.

For a text's code points c the array P[i] = sum of c[j] * base^j (j < i), modulo a prime,
answers whether any two spans are equal (compare the differences of P, shifted to a common
power) and finds the longest common extension of two positions by binary search. The hashes
of all spans of up to 12 code points (``SPANS``), taken from the same arrays, are reduced to one minimum
in each of ``BINS`` bins: the share of equal bins tells how much two texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import partitions

PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
BASES = (1103515245, 69069001)
# Lengths of spans: a text takes the largest that is at most a quarter of it, so that texts of
# nearly equal length share spans.
SPANS = (1, 3, 6, 12)
BINS = 64
EMPTY = 0xFFFF


class Powers:
    """base^0 .. base^n for each prime, grown by doubling."""

    def __init__(self):
        self.of = [np.array([1], np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> list[np.ndarray]:
        for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            while len(self.of[k]) <= n:
                have = self.of[k]
                step = np.uint64(pow(base, len(have), int(prime)))
                self.of[k] = np.concatenate([have, have * step % prime])
        return self.of


POWERS = Powers()


def points(text: str) -> np.ndarray:
    """Code points, counted from 1 so that leading zeros matter."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        values = points(text)
        self.n = len(values)
        powers = POWERS.upto(self.n)
        self.sums = []
        for prime, power in zip(PRIMES, powers, strict=True):
            sums = np.zeros(self.n + 1, np.uint64)
            # Terms are below 2^31, so a running sum of up to 2^33 of them is exact.
            np.cumsum(values % prime * power[: self.n] % prime, out=sums[1:])
            self.sums.append(sums % prime)

    def span(self, start: int, end: int, shift: int) -> tuple[int, ...]:
        """Hash of a span, multiplied by base^(shift - start)."""
        powers = POWERS.upto(shift)
        return tuple(
            int((s[end] + prime - s[start]) % prime * power[shift - start] % prime)
            for s, prime, power in zip(self.sums, PRIMES, powers, strict=True)
        )

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether the span from ``start`` equals the other text's span from ``at``."""
        shift = max(start, at)
        return self.span(start, start + length, shift) == other.span(at, at + length, shift)

    def common(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension from two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of ``length``."""
        if self.n < length:
            return np.array([], np.uint64)
        last = self.n - length
        powers = POWERS.upto(self.n)
        found = None
        for s, prime, power in zip(self.sums, PRIMES, powers, strict=True):
            # base^(last - start) brings every span to the power ``last``.. of this text; the
            # inverse of base^last then makes the value independent of the text's length.
            back = np.uint64(pow(int(power[last]), -1, int(prime)))
            lifted = (s[length:] + prime - s[: last + 1]) % prime * power[last::-1] % prime * back % prime
            found = lifted if found is None else (found << np.uint64(31)) | lifted
        return found


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads hashes over 64 bits, one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def fingerprint(prefixes: Prefixes) -> np.ndarray:
    """The smallest span hash of each bin in 16 bits; ``EMPTY`` for a bin without spans."""
    length = max((s for s in SPANS if s <= prefixes.n // 4), default=SPANS[0])
    hashes = np.sort(mixed(prefixes.spans(length)))
    # The bin is the highest bits, so the sorted hashes hold the bins one after another.
    bins = (hashes >> np.uint64(58)).astype(np.int64)
    found = np.full(BINS, EMPTY, np.uint16)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    kept = mixed(hashes[first]) & np.uint64(0xFFFF)
    found[bins[first]] = np.where(kept == EMPTY, EMPTY - 1, kept)
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fingerprint fills; two empty ones are equal."""
    filled = (a != EMPTY) | (b != EMPTY)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def hexadecimal(found: np.ndarray) -> str:
    return found.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


FINGERPRINTED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, common_prefix long"
)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, border) so that in each bucket every row is followed by the next one.

    Ids are cut into ranges at sampled quantiles. The first row of each range is also sent,
    marked as border, to the end of the range before, and the first of all to the end of the
    last. Only the ranges' smallest ids come to the driver: a number set by the partitions.
    """
    many = partitions(docs.sparkSession) * 4
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = body.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many).alias("q")).first()["q"]
    limits = sorted(set(cuts or []))
    placed = body.withColumn("bucket", F.coalesce(rank_among(limits), F.lit(-1)))
    firsts = {r["bucket"]: r["first"] for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}
    known = sorted(firsts)
    before = {b: known[i - 1] for i, b in enumerate(known)}
    to_before = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket")) if before else F.lit(0)
    borders = (
        placed.where(F.col("doc_id").isin([f for f in firsts.values() if f is not None]) | F.col("doc_id").isNull())
        # Of rows that share the id the one that comes first in the order.
        .groupBy("bucket", "doc_id")
        .agg(F.min("text").alias("text"))
        .withColumn("bucket", to_before.cast("int"))
    )
    return (
        placed.withColumn("border", F.lit(False))
        .unionByName(borders.withColumn("border", F.lit(True)))
        .repartition(partitions(docs.sparkSession), "bucket")
        .sortWithinPartitions("bucket", "border", F.col("doc_id").asc_nulls_first(), "text")
    )


def rank_among(limits: list[int]) -> Column:
    """The number of limits at or below doc_id, null for a null id.

    Counted in two steps of about the square root of their number: groups, then limits of one.
    """
    if not limits:
        return F.when(F.col("doc_id").isNotNull(), F.lit(0))
    size = max(1, int(len(limits) ** 0.5))
    groups = [limits[at : at + size] for at in range(0, len(limits), size)]
    group = at_or_below(longs([g[0] for g in groups]))
    inside = at_or_below(F.element_at(F.array(*map(longs, groups)), F.greatest(group, F.lit(1))))
    return F.when(F.col("doc_id").isNotNull(), F.greatest(group - 1, F.lit(0)) * size + inside)


def at_or_below(limits: Column) -> Column:
    return F.aggregate(limits, F.lit(0), lambda n, q: n + F.coalesce((q <= F.col("doc_id")).cast("int"), F.lit(0)))


def longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and likenesses.

    The next document is the one after it by doc_id (null first, equal ids by text), the first
    after the last; a lone document is its own next. A null text is empty; two empty
    fingerprints are alike (1). Equal texts have equal fingerprints. ``common_prefix`` is the
    longest common extension of both texts from their starts. An empty table gives no rows;
    other columns are ignored.
    """
    return in_order(docs).mapInArrow(pair_up, FINGERPRINTED)


def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over ordered rows; each is finished when the one after it in its bucket comes."""
    last = None
    for batch in batches:
        out = []
        columns = [batch[c] for c in ("doc_id", "text", "bucket", "border")]
        for row in range(batch.num_rows):
            doc_id, text, bucket, border = (c[row].as_py() for c in columns)
            prefixes = Prefixes(text)
            here = (doc_id, text, bucket, prefixes, fingerprint(prefixes))
            if last is not None and last[2] == bucket:
                out.append(compared(last, here))
            last = None if border else here
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("common_prefix", pa.int64()),
    ]
)


def compared(this: tuple, following: tuple) -> dict:
    doc_id, text, _, prefixes, own = this
    changed = edited(text, following[1])
    other = Prefixes(changed)
    theirs = fingerprint(other)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": hexadecimal(own),
        "edited_fingerprint": hexadecimal(theirs),
        "near_edited": likeness(own, theirs),
        "near_next": likeness(own, following[4]),
        "common_prefix": prefixes.common(0, other, 0),
    }
