"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; every other text is unlabelled. A linear
model over measures of style is fitted to the non-negative unbiased risk
``prior * R_pos(+) + max(0, R_unlabelled(-) - prior * R_pos(-))``: unlabelled texts count as
bad, the good ones expected among them are subtracted, and the difference may not go below
zero. The fit sees a bounded sample; scoring runs over whole texts in the scan.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from opsloom.llm.sampling import about, fold

HELD_OUT_FOLDS = 5
THRESHOLD = 0.3
# Rows of each kind that the fit may see: the bound of what reaches the driver.
POSITIVES = 6000
UNLABELLED = 6000
STEPS = 600
RATE = 0.05
DECAY = 1e-4
# Text measured at a time, so that memory for counting stays bounded.
WINDOW = 1 << 16

LETTERS = re.compile(r"[^\W\d_]")
UPPER_WORD = re.compile(r"\b[^\W\d_a-z]{2,}\b")
MARKS = re.compile(r"[^\w\s.,;:'\"()\-]")
MARKED_WORD = re.compile(r"\w[^\w\s.,;:'\"()\-]{2,}(?=\s|$)")
LONE_MARK = re.compile(r"(?:^|\s)[^\w\s]+(?=\s|$)")
DIGIT = re.compile(r"\d")


def measures(text: str | None) -> np.ndarray:
    """Style of a text: the mean and the extreme over its windows, each between 0 and 1 or so."""
    text = text or ""
    if not text.strip():
        return np.zeros(2 * len(measure_window("a")))
    found = np.array([measure_window(text[at : at + WINDOW]) for at in range(0, len(text), WINDOW)])
    lines = [line for line in text.split("\n") if len(line) > 20]
    parts = np.array([measure_window(line) for line in spread(lines)]) if len(lines) > 1 else found
    return np.concatenate([found.mean(axis=0), np.maximum(found.max(axis=0), parts.max(axis=0))])


def spread(lines: list[str]) -> list[str]:
    """Neighbouring lines joined so that a text of any length has at most eight parts."""
    size = -(-len(lines) // 8)
    return ["\n".join(lines[at : at + size]) for at in range(0, len(lines), size)]


def measure_window(text: str) -> list[float]:
    words = text.split()
    count = max(1, len(words))
    chars = max(1, len(text))
    different = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    raw = text.encode()
    upper = sum(map(str.isupper, words))
    return [
        upper / count,
        len(MARKS.findall(text)) / chars * 5,
        len(MARKED_WORD.findall(text)) / count,
        len(LONE_MARK.findall(text)) / count,
        len(DIGIT.findall(text)) / chars * 5,
        repeats / count,
        max(different.values(), default=0) / count,
        1 - len(different) / count,
        min(1.0, len(text) / count / 40),
        len(zlib.compress(raw, 1)) / max(64, len(raw)),
        min(1.0, np.log1p(count) / 12),
        text.count("\n") / count * 5,
    ]


@dataclass(frozen=True)
class Model:
    """A linear model over scaled measures and their squares; ``weights`` None: all score 0.5."""

    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.centre) / self.scale, -6, 6)
        return np.hstack([scaled, scaled**2 / 6, np.ones((len(rows), 1))])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(rows):
            return np.full(len(rows), 0.5)
        return sigmoid(self.inputs(rows) @ self.weights)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk under the logistic loss, by full-batch Adam steps.

    Where the unlabelled part of the risk falls below zero the step goes against its gradient
    alone, which undoes the overfitting that made it negative.
    """
    if not len(positive) or not len(unlabelled):
        return Model()
    rows = np.vstack([positive, unlabelled])
    shape = Model(rows.mean(axis=0), rows.std(axis=0) + 1e-6)
    good, mixed = shape.inputs(positive), shape.inputs(unlabelled)
    weights = np.zeros(good.shape[1])
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        on_good, on_mixed = good @ weights, mixed @ weights
        as_bad = np.logaddexp(0, on_mixed).mean() - prior * np.logaddexp(0, on_good).mean()
        slope_bad = (
            mixed.T @ sigmoid(on_mixed) / len(mixed) - prior * good.T @ sigmoid(on_good) / len(good)
        )
        slope_good = -prior * good.T @ sigmoid(-on_good) / len(good)
        slope = (slope_good + slope_bad if as_bad >= 0 else -slope_bad) + DECAY * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(shape.centre, shape.scale, weights)


@F.pandas_udf(ArrayType(DoubleType()))
def text_measures(text: pd.Series) -> pd.Series:
    return text.map(lambda t: measures(t).tolist())


def measured(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Measures of the documents with these ids: ``ids`` is a bounded sample.

    However often ``docs`` repeats an id, it gives one row: the least of its measures.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    each = chosen.select("doc_id", text_measures("text").alias("m")).groupBy("doc_id").agg(F.min("m").alias("m"))
    rows = [r["m"] for r in each.collect()]
    return np.array(rows, dtype=float).reshape(len(rows), -1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from training rows of ``labels`` (doc_id, quality) and unlabelled ``docs``.

    The class prior is the share of good rows among the training labels. Rows whose label or
    id is null teach nothing; without a good training row every text scores 0.5.
    """
    train = labels.where(fold("doc_id", HELD_OUT_FOLDS) != 0).where("doc_id is not null and quality is not null")
    told = train.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good")
    ).first()
    if not told["good"]:
        return Model()
    prior = min(0.98, told["good"] / told["n"])
    good = about(train.where("quality = 1").select("doc_id"), POSITIVES, 1)
    web = about(docs.where("doc_id is not null").select("doc_id"), UNLABELLED, 2)
    return fit_positive_unlabelled(measured(docs, good), measured(docs, web), prior)


def score_column(model: Model):
    """Score of ``text``: 0 to 1, higher for better texts. Depends on the text alone."""

    @F.pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.array([measures(t) for t in text])))

    return score("text")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and blank texts get the score of a text without any measure. Repeated rows score
    alike; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        (fold("doc_id", HELD_OUT_FOLDS) == 0).alias("held_out"),
        score_column(fit(docs, labels)).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged."""
    return docs.where(score_column(fit(docs, labels)) >= THRESHOLD)
