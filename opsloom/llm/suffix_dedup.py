"""Removal of long byte strings that repeat anywhere in a corpus, by suffix arrays of shards.

Every window of ``WINDOW`` bytes is filed under the smallest hash among its strings of
``GRAMS[0]`` bytes: equal windows share it, wherever they stand. Neighbouring windows with one
such anchor form a segment, and only hashes of segments travel. An anchor seen once has no
repeats; where all segments of an anchor are equal, all their windows repeat. One copy of each
remaining segment is gathered in shards of whole anchors, and the shard's suffix array
(induced sorting) with its permuted common prefixes tells which windows start twice. The few
anchors with more bytes than a shard holds are split by anchors of longer strings, up to whole
windows, so that a suffix array decides there too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from opsloom.llm.common import partitions, row_key, whole_text, written
from opsloom.llm.suffix_arrays import repeated_windows

WINDOW = 400
# Lengths of the strings that anchors are taken from: the next one splits what is too large.
GRAMS = (64, 232, WINDOW)
# Windows looked at in one go, and the most in one segment: both only cut work into pieces.
BLOCK = 1 << 17
SEGMENT = 2048
# Bytes of the anchors that share a shard, and of the different segments beyond which an anchor is
# split: no shard has more than the larger of both. A suffix array and all that goes with it take
# about 30 bytes for each.
SHARD = 2 << 20
HOT = 4 << 20
# Bytes that one task of the search reads, and that go to the JVM at once.
TASK_BYTES = 64 << 20
OUT_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
TABLE = np.random.default_rng(20).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the multiplier and of its inverse modulo 2^64."""

    def __init__(self, n: int):
        self.up = np.full(n + 1, MULTIPLIER, np.uint64)
        self.down = np.full(n + 1, INVERSE, np.uint64)
        self.up[0] = self.down[0] = 1
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)


POWERS: dict[int, Powers] = {}


def powers(n: int) -> Powers:
    """Powers up to at least ``n``; a size grows by doubling, up to a block and its border."""
    size = 1 << max(12, n.bit_length())
    if size not in POWERS:
        POWERS[size] = Powers(size)
    return POWERS[size]


def rolling(data: np.ndarray, length: int, table: int = 0) -> np.ndarray:
    """Hashes of all strings of ``length`` bytes, spread over 64 bits."""
    of = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[table][data] * of.up[: len(data)], out=sums[1:])
    found = (sums[length:] - sums[:-length]) * of.down[: len(data) - length + 1]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(32))


def least_in_reach(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of each ``reach`` neighbouring hashes, from minima of blocks' beginnings and ends."""
    count = len(hashes) - reach + 1
    full = -(-len(hashes) // reach) * reach
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(hashes)] = hashes
    rows = padded.reshape(-1, reach)
    beginnings = np.minimum.accumulate(rows, axis=1).reshape(-1)
    ends = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(ends[:count], beginnings[reach - 1 : reach - 1 + count])


def segments(data: bytes, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[bool]]]:
    """(anchors, first windows, last windows, segment hashes, whether an anchor stands twice)."""
    windows, reach = len(data) - WINDOW + 1, WINDOW - gram + 1
    for at in range(0, max(0, windows), BLOCK):
        view = memoryview(data)[at : at + BLOCK + WINDOW - 1]
        hashes = rolling(np.frombuffer(view, np.uint8), gram)
        least = least_in_reach(hashes, reach)
        count = len(least)
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        sizes = np.diff(np.append(starts, count))
        if sizes.max() > SEGMENT:
            starts = np.concatenate([np.arange(s, s + n, SEGMENT) for s, n in zip(starts, sizes, strict=True)])
            sizes = np.diff(np.append(starts, count))
        lasts = starts + sizes - 1
        digest = xxhash.xxh3_64_intdigest
        pairs = list(zip(starts.tolist(), lasts.tolist(), strict=True))
        own = [digest(view[a : b + WINDOW]) for a, b in pairs]
        twice = [bool(np.count_nonzero(hashes[a : b + reach] == least[a]) > 1) for a, b in pairs]
        yield least[starts], starts + at, lasts + at, own, twice


ANCHORS = "key binary, anchor long, segment long, first long, last long, twice boolean"


def anchoring(gram: int):
    """Segments of (key, body) rows by anchors of ``gram`` bytes."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch["key"], batch["body"], strict=True):
                for anchors, firsts, lasts, own, twice in segments(body.as_py(), gram):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(key, len(anchors)),
                            pa.array(anchors.view(np.int64)),
                            pa.array(np.array(own, np.uint64).view(np.int64)),
                            pa.array(firsts.astype(np.int64)),
                            pa.array(lasts.astype(np.int64)),
                            pa.array(twice, pa.bool_()),
                        ],
                        names=["key", "anchor", "segment", "first", "last", "twice"],
                    )

    return anchored


@F.pandas_udf(BinaryType())
def packed(body: pd.Series) -> pd.Series:
    """The bytes, compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
    return body.map(pack.compress)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, many, hot, body): the asked segments of each document, with their bytes."""
    for batch in batches:
        for row in range(batch.num_rows):
            data = unpack(batch["packed"][row].as_py())
            wanted = batch["wanted"][row].as_py()
            for at in range(0, len(wanted), 1024):
                part = wanted[at : at + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["anchor"] for w in part], pa.int64()),
                        pa.array([w["segment"] for w in part], pa.int64()),
                        pa.array([w["many"] for w in part], pa.bool_()),
                        pa.array([w["hot"] for w in part], pa.bool_()),
                        pa.array([data[w["first"] : w["last"] + WINDOW] for w in part], pa.binary()),
                    ],
                    names=["anchor", "segment", "many", "hot", "body"],
                )


FOUND = "anchor long, segment long, runs array<struct<first: long, last: long>>"


def runs_of(marked: np.ndarray) -> list[dict]:
    """Maximal runs of marked windows."""
    edges = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    firsts, lasts = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return [{"first": int(a), "last": int(b)} for a, b in zip(firsts, lasts, strict=True)]


def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of segments that come sorted by anchor, in shards of whole anchors."""
    for shard in shards_of(rows_of(batches)):
        yield searched(shard)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*[part[c].to_pylist() for c in ("anchor", "segment", "many", "body")], strict=True)


def shards_of(rows: Iterator[tuple[int, int, bool, bytes]]) -> Iterator[dict[tuple[int, int], tuple[bool, bytes]]]:
    """Whole anchors, together at most ``SHARD`` bytes or one anchor alone."""
    shard: dict[tuple[int, int], tuple[bool, bytes]] = {}
    size = 0
    for _, members in groupby(rows, key=lambda row: row[0]):
        # Repeated rows bring a segment again.
        anchor = {(a, segment): (many, body) for a, segment, many, body in members}
        more = sum(len(body) for _, body in anchor.values())
        if shard and size + more > SHARD:
            yield shard
            shard, size = {}, 0
        shard |= anchor
        size += more
    if shard:
        yield shard


def searched(shard: dict[tuple[int, int], tuple[bool, bytes]]) -> pa.RecordBatch:
    marked = repeated_windows([body for _, body in shard.values()], WINDOW)
    out = []
    for ((anchor, segment), (many, _)), windows in zip(shard.items(), marked, strict=True):
        # A segment that stands in several places repeats as a whole.
        runs = runs_of(np.ones_like(windows) if many else windows)
        if runs:
            out.append({"anchor": anchor, "segment": segment, "runs": runs})
    return pa.RecordBatch.from_pylist(out, schema=FOUND_SCHEMA)


FOUND_SCHEMA = pa.schema(
    [
        ("anchor", pa.int64()),
        ("segment", pa.int64()),
        ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)


def repeated_spans(keyed: DataFrame, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """key, spans: start and end bytes of all repeated windows of each (key, body) that has any.

    Rows that repeat a key have one body.
    """
    spark = keyed.sparkSession
    places = written(keyed.mapInArrow(anchoring(grams[0]), ANCHORS), "anchors")
    shared = (
        places.groupBy("anchor")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("segment").alias("low"),
            F.max("segment").alias("high"),
            F.max("twice").alias("twice"),
        )
        .where("n > 1 or twice")
        .select("anchor", ((F.col("n") > 1) & (F.col("low") == F.col("high"))).alias("alike"))
    )
    shared = written(shared, "shared-anchors")
    # Merge joins at every size: the plan does not change with the input.
    met = written(places.drop("twice").join(shared.hint("merge"), "anchor"), "met-anchors")
    alike = met.where("alike").select("key", "first", "last")
    open_ = met.where("not alike")
    kinds = written(
        open_.groupBy("anchor", "segment").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last")).alias("at")
        ),
        "segments",
    )
    sizes = written(
        kinds.groupBy("anchor").agg(F.sum(F.col("at.last") - F.col("at.first") + WINDOW).alias("bytes")), "anchor-bytes"
    )
    # A whole window as anchor has equal segments only, so the last length leaves nothing to split.
    is_hot = (F.col("bytes") > HOT) & F.lit(len(grams) > 1)
    hot = written(sizes.where(is_hot).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    asked = kinds.join(hot, "anchor", "left").select(
        F.col("at.key").alias("key"),
        F.struct(
            "anchor",
            "segment",
            (F.col("n") > 1).alias("many"),
            F.coalesce("hot", F.lit(False)).alias("hot"),
            F.col("at.first").alias("first"),
            F.col("at.last").alias("last"),
        ).alias("want"),
    )
    # A document's segments: as many as its length allows.
    wanted = asked.groupBy("key").agg(F.collect_list("want").alias("wanted"))
    texts = keyed.select("key", packed("body").alias("packed"))
    bodies = written(
        texts.join(written(wanted, "wanted").hint("merge"), "key")
        .select("packed", "wanted")
        .mapInArrow(cut_out, "anchor long, segment long, many boolean, hot boolean, body binary"),
        "bodies",
    )
    total = sizes.where(~is_hot).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(partitions(spark), total // TASK_BYTES + 1)
    found = (
        bodies.where("not hot")
        .repartition(tasks, "anchor")
        .sortWithinPartitions("anchor", "segment")
        .mapInArrow(search_shards, FOUND)
    )
    if not hot.isEmpty():
        found = found.unionByName(split_anchors(bodies.where("hot"), grams[1:]))
    found = written(found, "found")
    span = lambda r: F.struct(
        (F.col("first") + r["first"]).alias("start"), (F.col("first") + r["last"] + WINDOW).alias("end")
    )
    # One row per place, with all of its spans: places times spans may be far more.
    each = open_.join(found.hint("merge"), ["anchor", "segment"]).select("key", F.transform("runs", span).alias("spans"))
    whole = F.array(F.struct(F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end")))
    spans = each.unionByName(alike.select("key", whole.alias("spans")))
    # A set, because repeated rows bring the same spans again; bounded by the document's length.
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans"))))
    return spans.groupBy("key").agg(every.alias("spans"))


def split_anchors(hot: DataFrame, grams: tuple[int, ...]) -> DataFrame:
    """anchor, segment, runs: the same search over the different segments of large anchors, by longer strings.

    Equal windows share their first anchor, so windows of other anchors do no harm here.
    """
    name = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("anchor", "segment")]))
    rows = written(hot.dropDuplicates(["anchor", "segment"]).withColumn("key", name), "hot-segments")
    spans = written(repeated_spans(rows.select("key", "body"), grams), "hot-spans")
    windows = F.octet_length("body").cast("long") - WINDOW
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), windows.alias("last")))
    runs = joined_runs(F.transform("spans", lambda s: F.struct(s["start"].alias("first"), (s["end"] - WINDOW).alias("last"))))
    return (
        rows.join(spans.hint("merge"), "key", "left")
        # A segment that stands in several places repeats as a whole.
        .select("anchor", "segment", F.when(F.col("many"), whole).otherwise(runs).alias("runs"))
        .where("runs is not null")
    )


def joined_runs(runs: Column) -> Column:
    """Sorted runs of windows with those that meet or overlap joined: few, however finely they were found."""

    def step(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"))
        return F.when(run["first"] <= last["last"] + 1, F.array_append(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(
            F.array_append(done, run)
        )

    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.size(runs)), F.slice(runs, 1, 1), step)).otherwise(runs)


KEPT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
)


def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the union of its spans out of each document."""
    out, size = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            data = unpack(batch["packed"][row].as_py())
            kept, at, count = [], 0, 0
            for span in batch["spans"][row].as_py() or []:
                if count == 0 or span["start"] > at:
                    kept.append(data[at : span["start"]])
                    count += 1
                at = max(at, span["end"])
            rest = b"".join([*kept, data[at:]])
            out.append((batch["doc_id"][row].as_py(), len(data), len(data) - len(rest), count, rest))
            size += len(rest)
            if size >= OUT_BYTES or len(out) >= 1024:
                yield kept_rows(out)
                out, size = [], 0
    yield kept_rows(out)


def kept_rows(out: list[tuple[int | None, int, int, int, bytes]]) -> pa.RecordBatch:
    ids, sizes, removed, counts, rests = zip(*out, strict=True) if out else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in rests], pa.string()),
            pa.array(rests, pa.binary()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: one row per row of ``docs``.

    Removed is every byte covered by a string of ``WINDOW`` bytes that starts at least twice
    in the table, be it in one document; judged on the input, so all copies go. A null text is
    empty; texts shorter than a window stay whole. Rows that repeat doc_id and text count as
    copies of each other. ``kept`` are the remaining bytes, which may cut a character in two.
    An empty table gives no rows; other columns are ignored.
    """
    body = whole_text().cast("binary")
    texts = docs.select(row_key().alias("key"), "doc_id", packed(body).alias("packed"))
    spans = written(repeated_spans(docs.select(row_key().alias("key"), body.alias("body"))), "spans")
    return (
        texts.join(spans.hint("merge"), "key", "left")
        .select("doc_id", "packed", "spans")
        .mapInArrow(without_spans, KEPT)
    )
