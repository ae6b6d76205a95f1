"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton holds all pieces. Reading a text once, it gives at each position the longest
piece that ends there and, by its output links, all shorter ones; each of them may improve
the best score at that position. A character that no piece covers costs more than any piece
and is written as its bytes, so decoding gives back every text exactly.

White space is kept: a space becomes the mark U+2581, and a mark that stands in the text goes
through bytes. No piece holds a mark after another character, nor a line end: texts are cut
there without changing the best path, and the paths of short parts are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Stands for a mark of the text itself; lone surrogates are in no text and in no piece.
OWN_MARK = "\udc81"
# Bytes of a worker's remembered parts (about what their objects take), and the longest part remembered.
MEMORY = 48 << 20
PART = 48
# Parts of a text and ids whose objects exist at once, and bytes of texts encoded into one batch.
RUN = 1 << 14
OUT_BYTES = 1 << 20
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with scores by id; ``kinds`` says piece, byte or other (control, unknown)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]
    whole_parts: re.Pattern = field(init=False)

    def __post_init__(self):
        texts = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k == "piece"]
        # Cutting before a mark is exact only if no piece has one after another character.
        if any(MARK in p.lstrip(MARK) for p in texts):
            self.whole_parts = re.compile("(?s).+")
        elif any("\n" in p for p in texts):
            self.whole_parts = re.compile(f"(?s){MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.whole_parts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Reads a model file on the driver; its table is bounded by the vocabulary and sent along."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))
    ids = range(model.get_piece_size())
    kind = lambda i: (
        "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    )
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids])


class Coder:
    """Encodes and decodes with one vocabulary; built once in each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.parts = vocabulary.whole_parts
        self.bytes = [0] * 256
        self.out: list[bytes] = [b""] * len(vocabulary.pieces)
        self.automaton = ahocorasick.Automaton()
        scores = []
        for i, (piece, score, kind) in enumerate(
            zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)
        ):
            if kind == "byte":
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.out[i] = bytes([value])
            elif kind == "piece":
                self.automaton.add_word(piece, (len(piece), score, i))
                self.out[i] = piece.replace(MARK, " ").encode()
                scores.append(score)
        self.automaton.make_automaton()
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        # Ids as 32-bit integers: a remembered part takes its characters, its bytes and two headers.
        self.known: dict[str, bytes] = {}
        self.room = MEMORY

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; beside it and them only ``RUN`` parts are held at once."""
        if MARK in text:
            text = text.replace(MARK, OWN_MARK)
        runs, run = [], []
        for part in self.parts.finditer(text.replace(" ", MARK)):
            run.append(self.part_ids(part.group()))
            if len(run) == RUN:
                runs.append(b"".join(run))
                run = []
        return np.frombuffer(b"".join([*runs, *run]), np.int32)

    def part_ids(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = np.array(self.best_path(part), np.int32).tobytes()
            if len(part) <= PART and self.room > 0:
                self.known[part] = found
                self.room -= 200 + 2 * len(part) + len(found)
        return found

    def best_path(self, part: str) -> list[int]:
        """Ids of the segmentation with the highest score; of equal ones, with the longer last piece."""
        n = len(part)
        best = [0.0] * (n + 1)
        step = [1] * (n + 1)
        piece = [-1] * (n + 1)
        reached, unknown = 0, self.unknown
        for end, (length, score, i) in self.automaton.iter(part):
            end += 1
            while reached < end:
                best[reached + 1] = best[reached] + unknown
                reached += 1
            score += best[end - length]
            if score > best[end]:
                best[end], step[end], piece[end] = score, length, i
        while reached < n:
            best[reached + 1] = best[reached] + unknown
            reached += 1
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
                at -= step[at]
            else:
                at -= 1
                raw = (MARK if part[at] == OWN_MARK else " " if part[at] == MARK else part[at]).encode()
                ids.extend(self.bytes[b] for b in reversed(raw))
        return ids[::-1]

    def decoded_bytes(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text's bytes, ``RUN`` ids at a time."""
        out = self.out
        for at in range(0, len(ids), RUN):
            yield b"".join([out[i] for i in ids[at : at + RUN].tolist()])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.decoded_bytes(ids)).decode()

    def gives_back(self, ids: np.ndarray, text: str) -> bool:
        """Whether decoding the ids gives the text."""
        data, at = text.encode(), 0
        for run in self.decoded_bytes(ids):
            if data[at : at + len(run)] != run:
                return False
            at += len(run)
        return at == len(data)


ENCODED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_tokens", LongType()),
        StructField("tokens", ArrayType(IntegerType())),
        StructField("round_trip", BooleanType()),
    ]
)


def encoded(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip: one row per row of ``docs``, texts whole.

    A null text is empty; an empty text has no tokens; repeated rows give repeated results;
    an empty table gives none; other columns are ignored. ``round_trip`` tells that decoding
    the tokens gives the text again. A very long text is held with its ids, four bytes each;
    a part without a space or line end is one piece of work, about 60 bytes a character.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            yield from encoded_rows(coder, batch)

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED)


def encoded_rows(coder: Coder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows' results in batches of about ``OUT_BYTES`` of text."""
    first, size = 0, 0
    rows: list[np.ndarray] = []
    same: list[bool] = []
    for text in batch["text"]:
        text = text.as_py() or ""
        ids = coder.encode(text)
        same.append(coder.gives_back(ids, text))
        rows.append(ids)
        size += len(text)
        if size >= OUT_BYTES or len(rows) == 1024:
            yield token_batch(batch["doc_id"].slice(first, len(rows)), rows, same)
            first, size, rows, same = first + len(rows), 0, [], []
    if rows:
        yield token_batch(batch["doc_id"].slice(first, len(rows)), rows, same)


def token_batch(doc_ids: pa.Array, rows: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
    sizes = np.array([len(r) for r in rows], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(sizes), tokens, pa.array(same, pa.bool_())], names=ENCODED.names
    )


def decoded(rows: DataFrame, path: str = MODEL_PATH, column: str = "tokens") -> DataFrame:
    """(doc_id, text) from rows with token ids; null tokens give a null text."""
    spark: SparkSession = rows.sparkSession
    shared = spark.sparkContext.broadcast(load(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [coder.decode(ids.values.to_numpy()) if ids.is_valid else None for ids in part[column]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", column).mapInArrow(decode, "doc_id long, text string")
