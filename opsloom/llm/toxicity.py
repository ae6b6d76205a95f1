"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and digits and
signs to the letters they stand for, so that disguised spellings meet the plain ones; letters
that one digit can stand for (i and l) fold to one. Weights are log-odds learned from
training labels over words and word beginnings, next to a short seed list. A text's hits,
less those inside exception phrases, are summed, divided by a slowly growing function of its
length, and turned into a probability fitted on the same training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from opsloom.llm.sampling import about, fold

HELD_OUT_FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
# Labelled rows that the fit may see, and entries of the learned lexicon.
SAMPLE = 20_000
ENTRIES = 4096
# Evidence that an entry needs: twice the log-likelihood ratio, and the log-odds themselves.
EVIDENCE = 24.0
LEAST_ODDS = 1.5
BEGINNINGS = (4, 5, 6)
SEED_WEIGHT = 4.0
# Plain insults that count before anything is learned.
SEED_WORDS = """
idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb imbecile jerk
bastard asshole bitch fucker shithead retard
connard abruti salope crétin arschloch wichser vollidiot hurensohn pendejo cabrón gilipollas
""".split()
# Phrases in which such a word is harmless.
EXCEPTIONS = """
idiot proof|idiot light|pond scum|trash can|trash bin|trash bag|take out the trash|clown fish
class clown|circus clown|sore loser|loser bracket|jerk chicken|dumb waiter|retard the spread
""".replace("\n", "|").strip("|").split("|")
# Letters of other scripts and the Latin ones they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i"}
FOLD = {ord(a): b for a, b in STANDS_FOR.items()}
FOLD |= {ord(a): STANDS_FOR.get(b, b) for a, b in LOOK_ALIKES.items()}
# Full-width letters and digits.
FOLD |= {0xFEE0 + ord(c): FOLD.get(ord(c), c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}
INNER_SIGN = re.compile(r"(?<=\w)[@$](?=\w)|\b[@$](?=[^\W\d_])")
GAP = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """The folded text: words of letters between single spaces, a space at either end."""
    text = (text or "").lower()
    if "@" in text or "$" in text:
        text = INNER_SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return " " + GAP.sub(" ", text.translate(FOLD)).strip() + " "


def entries_of(text: str | None) -> set[str]:
    """What the lexicon could know of a text: " word " and the beginnings of its words."""
    found = set()
    for word in set(folded(text).split()):
        if len(word) >= 3:
            found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)
    return found


def seed_lexicon() -> dict[str, float]:
    return {folded(word): SEED_WEIGHT for word in SEED_WORDS}


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=seed_lexicon)
    bias: float = -4.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        """Entries with their weights and exception phrases with weight None."""
        found = ahocorasick.Automaton()
        for phrase in EXCEPTIONS:
            found.add_word(folded(phrase), (len(folded(phrase)), None))
        for entry, weight in self.lexicon.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found


def strength(automaton: ahocorasick.Automaton, text: str | None) -> float:
    """Weight of the hits of a text over its length, 0 without any.

    A word counts once with the largest weight among its entries, however many match at it.
    """
    body = folded(text)
    hits: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(body):
        start = end - length + 1
        if weight is None:
            safe.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    if safe:
        hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in safe)}
    if not hits:
        return 0.0
    # A long text may hold an odd chance hit; one clear insult still weighs in it.
    return sum(hits.values()) / np.sqrt(1 + np.log1p(body.count(" ") / 500))


def count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, clean): how many texts of each label have the entry, per task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            (toxic if label else clean).update(entries_of(text))
        if len(toxic) + len(clean) > 500_000:
            yield counted(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield counted(toxic, clean)


def counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    known = list(toxic | clean)
    return pa.RecordBatch.from_pydict(
        {
            "entry": pa.array(known, pa.string()),
            "toxic": pa.array([toxic[e] for e in known], pa.int64()),
            "clean": pa.array([clean[e] for e in known], pa.int64()),
        }
    )


COUNTS = StructType(
    [StructField("entry", StringType()), StructField("toxic", LongType()), StructField("clean", LongType())]
)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and calibration from training rows of ``labels`` (doc_id, toxic), a bounded sample.

    Rows whose label or id is null teach nothing. Without training rows of both kinds the
    seed list and its fixed calibration remain.
    """
    train = labels.where(fold("doc_id", HELD_OUT_FOLDS) != HELD_OUT).where(
        "doc_id is not null and toxic is not null"
    )
    chosen = about(train, SAMPLE, 3).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, fine = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not fine:
        return Model()
    n, toxic, clean = F.col("toxic") + F.col("clean"), F.col("toxic"), F.col("clean")
    share = bad / (bad + fine)
    # Twice the log-likelihood ratio of the entry's own share of toxic texts to the overall one.
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    found = (
        rows.select("text", "toxic")
        .mapInArrow(count_entries, COUNTS)
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 3")
        .withColumn("odds", F.log((toxic + 0.5) / (bad + 1)) - F.log((clean + 0.5) / (fine + 1)))
        .withColumn("evidence", 2 * (term(toxic, share) + term(clean, 1 - share)))
        .where((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("evidence"), "entry")
        .limit(ENTRIES)
        .collect()
    )
    lexicon = seed_lexicon() | {r["entry"]: r["odds"] for r in found}
    return calibrated(lexicon, rows)


def calibrated(lexicon: dict[str, float], rows: DataFrame) -> Model:
    """Fits the probability to the sample's strengths by Newton steps with a weak prior.

    A repeated id counts once, with the largest strength among its texts.
    """
    model = Model(lexicon)

    @F.pandas_udf(DoubleType())
    def weigh(text: pd.Series) -> pd.Series:
        automaton = model.automaton()
        return text.map(lambda t: strength(automaton, t)).astype(float)

    weighed = rows.select("doc_id", weigh("text").alias("x"), F.col("toxic").cast("int").alias("y"))
    pairs = weighed.groupBy("doc_id", "y").agg(F.max("x").alias("x")).collect()
    x = np.array([[1.0, p["x"]] for p in pairs])
    y = np.array([p["y"] for p in pairs], dtype=float)
    start = np.array([Model.bias, Model.slope])
    beta = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.5])
        beta -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + 0.5 * (beta - start)), -2, 2)
    return Model(lexicon, float(beta[0]), float(max(beta[1], 0.1)))


def score_column(model: Model):
    """Score of ``text``: 0 to 1. Depends on the text alone."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for text in batches:
            z = np.array([strength(automaton, t) for t in text], dtype=float) * model.slope + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score("text")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null, blank and harmless texts get the score of a text without hits. Repeated rows score
    alike; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        (fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        score_column(fit(docs, labels)).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
