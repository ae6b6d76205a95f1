"""Importance resampling towards a target: documents drawn by hashed n-gram weights.

A lot of texts has a dictionary of its distinct words, each between two delimiters, in an
Aho-Corasick automaton. Its payloads are the words' CRC-32 and lengths. One scan of the lot
gives the payload of every word; CRCs of neighbouring words combine by shifting one past the
length of the other, so that runs of two and three words get their buckets without being
spelled out. The first scan counts buckets, the second one sums their gains per document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import written
from opsloom.plans.ranking import SLICE_ROWS, ordered_rank

BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
# Of a hundred documents with enough words so many are drawn.
DRAWN = 5
# Bytes of a lot, of a piece of a long text, and of a word that the automaton spells out.
LOT, PIECE, SPELLED = 2 << 20, 1 << 20, 64
# Upper case to lower; what is neither letter, digit nor beyond ASCII to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """Tables [k, byte place, byte]: what a CRC becomes by 2^k further zero bytes."""
    places = np.arange(256, dtype=np.uint32)
    one = places.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    tables = np.empty((32, 4, 256), np.uint32)
    # One zero byte: the lowest byte goes through the table, the others move down.
    for place in range(4):
        value = places << np.uint32(8 * place)
        tables[0, place] = one[value & 0xFF] ^ (value >> np.uint32(8))
    for k in range(1, 32):
        for place in range(4):
            tables[k, place] = through(tables[k - 1], tables[k - 1, place])
    return tables


def through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    found = table[0][crc & low] ^ table[1][(crc >> np.uint32(8)) & low]
    found ^= table[2][(crc >> np.uint32(16)) & low]
    return found ^ table[3][crc >> np.uint32(24)]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC as it is after its number of further zero bytes."""
    tables = shift_tables()
    out = crc.copy()
    most = int(lengths.max(initial=0))
    for k in range(most.bit_length()):
        these = np.flatnonzero((lengths >> k) & 1)
        out[these] = through(tables[k], out[these])
    return out


class Dictionary:
    """The distinct words of a lot: CRC of each, CRC of a space and the word, length of both."""

    def __init__(self, words: set[bytes]):
        self.automaton = ahocorasick.Automaton()
        self.stand_in: dict[bytes, str] = {}
        crcs, spaced, sizes = [], [], []
        for i, word in enumerate(words):
            crcs.append(zlib.crc32(word))
            spaced.append(zlib.crc32(b" " + word))
            sizes.append(len(word) + 1)
            spelled = word.decode("latin-1")
            if len(word) > SPELLED:
                # No folded text holds a control character.
                spelled = self.stand_in[word] = f"\x01{i}\x01"
            self.automaton.add_word(f" {spelled} ", i)
        self.automaton.make_automaton()
        self.crcs, self.spaced = np.array(crcs, np.uint32), np.array(spaced, np.uint32)
        self.sizes = np.array(sizes, np.int64)

    def scan(self, text: str, count: int) -> np.ndarray:
        return np.fromiter((i for _, i in self.automaton.iter(text)), np.int64, count)


def pieces_of(text: str | None) -> Iterator[bytes]:
    """The folded text in pieces that end between words."""
    data = (text or "").encode().translate(FOLD)
    at = 0
    while len(data) - at > PIECE:
        end = data.rfind(b" ", at, at + PIECE)
        end = end if end > at else data.find(b" ", at + PIECE)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


class Scanner:
    """Buckets of the features of documents, lot by lot.

    A document may go over several lots: its last two words are taken along.
    """

    def __init__(self):
        self.pieces: list[tuple[int, list[bytes]]] = []
        self.size = 0
        self.carried: tuple[int, list[bytes]] | None = None

    def add(self, doc: int, piece: bytes) -> bool:
        """True where the lot is full."""
        words = piece.split()
        self.size += len(piece)
        if words:
            self.pieces.append((doc, words))
        return self.size >= LOT

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents of words, documents of features, buckets of features) of the lot."""
        lot, known = self.pieces, 0
        if self.carried and lot and lot[0][0] == self.carried[0]:
            # Words of the last lot: they begin runs, but are not features of their own again.
            known = len(self.carried[1])
            lot = [self.carried, *lot]
        self.pieces, self.size = [], 0
        if not lot:
            return (np.zeros(0, np.int64),) * 3
        dictionary = Dictionary(set().union(*(words for _, words in lot)))
        long = dictionary.stand_in
        texts = [
            b" ".join(words).decode("latin-1")
            if not long
            else " ".join(long.get(w) or w.decode("latin-1") for w in words)
            for _, words in lot
        ]
        sizes = [len(words) for _, words in lot]
        docs = np.repeat(np.array([doc for doc, _ in lot], np.int64), sizes)
        ids = dictionary.scan(f" {' '.join(texts)} ", len(docs))
        self.carried = self.tail(lot)
        one = dictionary.crcs[ids]
        spaced, length = dictionary.spaced[ids], dictionary.sizes[ids]
        two = shifted(one[:-1], length[1:]) ^ spaced[1:]
        three = shifted(two[:-1], length[2:]) ^ spaced[2:]
        new = np.arange(len(docs)) >= known
        keep = [new, (docs[:-1] == docs[1:]) & new[1:], (docs[:-2] == docs[2:]) & new[2:]]
        buckets = np.concatenate([c[k] for c, k in zip((one, two, three), keep, strict=True)]) % np.uint32(BUCKETS)
        owners = np.concatenate([docs[new], docs[1:][keep[1]], docs[2:][keep[2]]])
        return docs[new], owners, buckets.astype(np.int64)

    @staticmethod
    def tail(lot: list[tuple[int, list[bytes]]]) -> tuple[int, list[bytes]]:
        """The last document of a lot and at most two of its last words."""
        doc, last = lot[-1][0], []
        for owner, words in reversed(lot):
            if owner != doc or len(last) >= 2:
                break
            last = words[-2:] + last
        return doc, last[-2:]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): one row per bucket and task."""
    totals, scanner, doc = np.zeros(BUCKETS, np.int64), Scanner(), 0

    def flush():
        nonlocal totals
        totals += np.bincount(scanner.features()[2], minlength=BUCKETS)

    for batch in batches:
        for value in batch["text"]:
            for piece in pieces_of(value.as_py()):
                if scanner.add(doc, piece):
                    flush()
            doc += 1
    flush()
    found = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame) -> dict[int, int]:
    """Features per bucket; at most as many entries as there are buckets."""
    sums = docs.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in sums.collect()}


def bucket_gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket."""
    all_corpus, all_target = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return np.array(
        [
            math.floor(
                1000.0 * math.log((target.get(b, 0) + 1.0) * all_corpus / ((corpus.get(b, 0) + 1.0) * all_target))
            )
            for b in range(BUCKETS)
        ],
        np.int64,
    )


WEIGHED = "doc_id long, n_features long, n_words long, weight long"


def weighing(gains: np.ndarray):
    """Sums the gains of each document's features."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weights = (np.zeros(n, np.int64) for _ in range(3))
            scanner = Scanner()

            def flush(scanner=scanner, n=n, words=words, features=features, weights=weights):
                of_words, owners, buckets = scanner.features()
                words += np.bincount(of_words, minlength=n)
                features += np.bincount(owners, minlength=n)
                # Sums of a lot are far below 2^53, so doubles hold them exactly.
                weights += np.bincount(owners, gains[buckets], minlength=n).astype(np.int64)

            for row, value in enumerate(batch["text"]):
                for piece in pieces_of(value.as_py()):
                    if scanner.add(row, piece):
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(features), pa.array(words), pa.array(weights)],
                names=["doc_id", "n_features", "n_words", "weight"],
            )

    return weighed


def noise(seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) of a uniform number drawn from the id; a null id counts as an empty text."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of ``docs``.

    Features are runs of one to three words of the lower-cased text, repeats counted; buckets
    are counted over all texts of ``docs`` and of ``target``. Of the documents with at least
    ``min_words`` words ``drawn`` in a hundred are drawn, the highest scores first, then the
    smaller doc_id (null last). Null and empty texts have no features and weight 0. Repeated
    rows are documents of their own; which of two rows that are equal in all of this comes
    first makes no difference. Empty tables: no rows, or no target counts. Long texts are read
    in pieces. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    rows = docs.select("doc_id", "text").mapInArrow(weighing(gains), WEIGHED)
    score = (F.col("weight") + noise(seed)).alias("score")
    scored = written(
        rows.select("doc_id", "n_features", "weight", score, (F.col("n_words") >= min_words).alias("enough"), F.rand(1).alias("drawn")),
        "resampling-scores",
    )
    sizes = scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if("enough").alias("enough")).first()
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("drawn")]
    # Ranges of the order, so that no task sorts all; a random last column cuts equal rows apart.
    slices = max(8, -(-sizes["rows"] // SLICE_ROWS))
    ranks = ordered_rank(scored, [], order, "place", split=True, slices=slices)
    most = sizes["enough"] * drawn // 100
    rank = F.when(F.col("place") <= most, F.col("place"))
    return ranks.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
