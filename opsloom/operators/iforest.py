"""Isolation forest on (cpu, memory, latency): trees from a bounded sample, scoring in batches.

Rows, split features and thresholds are drawn from MD5 digests of what they belong to, so a
forest depends on the data alone and any engine with MD5 can grow the same one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators.anomaly import METRICS, baseline_stats, zscore
from opsloom.plans.durable import durable
from opsloom.plans.quantiles import exact_quantiles
from opsloom.session import ship_package

# Forest size, sample per tree, share of outliers, seed and severity limit.
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.05
SEED = 42
CRITICAL_SCORE = -0.65
EULER_GAMMA = 0.5772156649

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"
# Candidate rows drawn per sampled row, so that the first places are surely among them.
OVERSAMPLE = 4
# A row's place in a tree is a number below this prime.
PLACES = 2147483647
# Digits that scores keep: the order in which paths are added up must not decide.
SCORE_DIGITS = 9


def average_path(n):
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    full = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def training_sample(events: DataFrame, row_id: str, trees: int, psi: int, seed: int) -> DataFrame:
    """``psi`` rows per tree, or all if there are fewer: the same rows under any partitioning.

    One digest per row gives two numbers, and they give the row a place in each tree. A limit
    on the places keeps a few multiples of the wanted rows during the scan; only those are
    ranked. Rows with a metric that is null, NaN or infinite are left out.
    """
    base = usable(events.select(F.col(row_id).alias("_id"), *[F.col(m).cast("double").alias(m) for m in METRICS]))
    total = base.count()
    limit = PLACES if total <= psi * OVERSAMPLE else int(PLACES * (psi * OVERSAMPLE / total))
    digest = F.md5(F.concat_ws("|", F.lit("forest"), F.lit(str(seed)), F.col("_id").cast("string")))
    number = lambda at: F.conv(F.substring(F.col("_d"), at, 8), 16, 10).cast("bigint")
    drawn = base.withColumn("_d", digest).select(
        "_id", *METRICS, (number(1) % PLACES).alias("_a"), (number(9) % (PLACES - 1) + 1).alias("_b")
    )
    place = lambda tree: (F.col("_a") + tree * F.col("_b")) % PLACES
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: place(tree) < limit)
    each = drawn.withColumn("tree", F.explode(chosen)).withColumn("_place", place(F.col("tree")))
    rank = F.row_number().over(W.partitionBy("tree").orderBy("_place", "_id"))
    return each.withColumn("_r", rank).where(F.col("_r") <= psi).select("_id", *METRICS, "tree")


def usable(events: DataFrame) -> DataFrame:
    finite = [F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")) for m in METRICS]
    return events.where(reduce(lambda a, b: a & b, finite))


def draw(seed: int, tree: int, node: int) -> tuple[int, float]:
    """A number to choose the feature by and a position between 0 and 1."""
    digest = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16) / 2**32


def grow_tree(pdf: pd.DataFrame, seed: int, psi: int) -> pd.DataFrame:
    """One random tree as a node table; ``path`` is the depth credited at a leaf.

    The root is node 0; the children of a node n are 2n + 1 and 2n + 2.
    """
    tree = int(pdf["tree"].iloc[0])
    rows = pdf[list(METRICS)].to_numpy(dtype=float)
    limit = int(np.ceil(np.log2(max(2, min(psi, len(rows))))))
    nodes = []
    pending = [(0, rows, 0)]
    while pending:
        node, part, depth = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        spread = np.flatnonzero(low < high)
        if depth >= limit or not len(spread):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(average_path(len(part)))))
            continue
        choice, position = draw(seed, tree, node)
        feature = int(spread[choice % len(spread)])
        threshold = float(low[feature] + (high[feature] - low[feature]) * position)
        if threshold >= high[feature]:
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        left, right = 2 * node + 1, 2 * node + 2
        nodes.append((tree, node, feature, threshold, left, right, 0.0))
        pending.append((left, part[goes_left], depth + 1))
        pending.append((right, part[~goes_left], depth + 1))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def fit_nodes(
    events: DataFrame, row_id: str = "seq", trees: int = TREES, psi: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """The forest as a node table, at most trees x (2 psi - 1) rows; trees grow in parallel."""
    ship_package(events.sparkSession)
    sample = training_sample(events, row_id, trees, psi, seed)
    return sample.groupBy("tree").applyInPandas(lambda pdf: grow_tree(pdf, seed, psi), NODE_SCHEMA)


def _forest_arrays(nodes: DataFrame, trees: int, psi: int) -> list[tuple]:
    """Node arrays per tree on the driver; the row bound is checked, not assumed."""
    bound = trees * (2 * psi - 1)
    table = nodes.limit(bound + 1).toPandas()
    if len(table) > bound:
        raise ValueError("the node table is larger than the forest it should describe")
    forest = []
    for _, part in table.groupby("tree", sort=True):
        by_node = part.set_index("node").reindex(range(int(part["node"].max()) + 1), fill_value=-1)
        forest.append(tuple(by_node[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")))
    return forest


def path_lengths(forest: list[tuple], values: np.ndarray) -> np.ndarray:
    """Mean path length of every row over all trees."""
    total = np.zeros(len(values))
    index = np.arange(len(values))
    for feature, threshold, left, right, path in forest:
        at = np.zeros(len(values), dtype=np.int64)
        inner = feature[at] >= 0
        while inner.any():
            rows = index[inner]
            where = at[rows]
            goes_left = values[rows, feature[where]] <= threshold[where]
            at[rows] = np.where(goes_left, left[where], right[where])
            inner[rows] = feature[at[rows]] >= 0
        total += path[at]
    return total / len(forest)


def score_samples(
    events: DataFrame, nodes: DataFrame, trees: int = TREES, psi: int = SAMPLE_ROWS, rows_fitted: int | None = None
) -> DataFrame:
    """Adds ``score`` in (-1, 0); the lower, the more isolated. Unusable rows have none."""
    ship_package(events.sparkSession)
    forest = events.sparkSession.sparkContext.broadcast(_forest_arrays(nodes, trees, psi))
    scale = float(average_path(min(psi, rows_fitted or psi)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[list(METRICS)].to_numpy(dtype=float)
            score = -np.power(2.0, -path_lengths(forest.value, values) / scale)
            batch["score"] = np.where(np.isfinite(values).all(axis=1), np.round(score, SCORE_DIGITS), np.nan)
            yield batch

    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    scored = events.mapInPandas(score, f"{fields}, score double")
    return scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def training_offset(scored: DataFrame, contamination: float = CONTAMINATION) -> float:
    """The score below which ``contamination`` of the training rows fall."""
    frozen = durable(scored.select(F.lit(1).alias("_all"), "score"))
    row = exact_quantiles(frozen, ["_all"], "score", [contamination], ["offset"]).first()
    return row["offset"]


def forest_verdicts(scored: DataFrame, offset: float) -> DataFrame:
    """Flag, severity and confidence from the score."""
    flagged = F.coalesce(F.col("score") < offset, F.lit(False))
    severity = F.when(flagged & (F.col("score") < CRITICAL_SCORE), "CRITICAL").when(flagged, "WARNING")
    return scored.select(
        *[c for c in scored.columns if c != "score"],
        F.lit("multivariate_telemetry").alias("metric_name"),
        flagged.alias("is_anomaly"),
        F.round(-F.col("score"), 2).alias("confidence"),
        severity.otherwise("NORMAL").alias("severity"),
        F.round("score", 4).alias("anomaly_score"),
    )


def unfitted_verdicts(events: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Without a forest the latency z-score decides."""
    if baseline is None:
        verdict = zscore("latency_ms", F.col("latency_ms"), F.lit(None).cast("double"), F.lit(1.0))
        return events.withColumn("verdict", verdict)
    joined = events.join(baseline, "service_name", "left")
    verdict = zscore("latency_ms", F.col("latency_ms"), F.col("latency_ms_mean"), F.col("latency_ms_std"))
    return joined.select(*events.columns, verdict.alias("verdict"))


__all__ = [
    "average_path",
    "baseline_stats",
    "fit_nodes",
    "forest_verdicts",
    "score_samples",
    "training_offset",
    "training_sample",
    "unfitted_verdicts",
]
