"""Per-service request volume, availability, latency quantiles and mean load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.functions.numeric import tidy
from opsloom.plans.joins import match
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.sizing import fits_one_task, small_side

PROBS = (0.50, 0.95, 0.99)
# Size of a stored latency sketch, and the rank error it stays within (99 % of the time).
SKETCH_K, SKETCH_RANK_ERROR = 4096, 0.001
LATENCY_COLUMNS = ("latency_p50_ms", "latency_p95_ms", "latency_p99_ms")
SLA_COLUMNS = (
    "service_name total_requests total_errors_5xx availability_sla latency_p50_ms "
    "latency_p95_ms latency_p99_ms avg_cpu_percent avg_memory_percent"
).split()


def _volume():
    errors = F.count_if(F.col("status_code") >= 500)
    total = F.count(F.lit(1))
    return [
        total.alias("total_requests"),
        errors.alias("total_errors_5xx"),
        tidy((total - errors) / total * 100.0, 4).alias("availability_sla"),
        tidy(F.avg("cpu_percent"), 2).alias("avg_cpu_percent"),
        tidy(F.avg("memory_percent"), 2).alias("avg_memory_percent"),
    ]


def _ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    extra = [k for k in keys if k != "service_name"]
    return df.select("service_name", *extra, *SLA_COLUMNS[1:])


def service_sla(
    events: DataFrame, keys: Sequence[str] = ("service_name",), split: bool | None = None
) -> DataFrame:
    """SLA metrics with exact quantiles, one row per key; rows without a service are dropped."""
    keys = list(keys)
    rows = events.where(F.col("service_name").isNotNull())
    if split is None:
        split = not fits_one_task(rows.select(*keys, "latency_ms"))
    if not split:
        quantiles = F.percentile("latency_ms", F.array(*[F.lit(p) for p in PROBS]))
        grouped = rows.groupBy(*keys).agg(*_volume(), quantiles.alias("_q"))
        flat = grouped.select(
            "*", *[tidy(F.col("_q")[i], 2).alias(c) for i, c in enumerate(LATENCY_COLUMNS)]
        )
        return _ordered(flat, keys)
    volume = rows.groupBy(*keys).agg(*_volume())
    latency = exact_quantiles(rows, keys, "latency_ms", PROBS, LATENCY_COLUMNS, split=True)
    rounded = latency.select(*keys, *[tidy(F.col(c), 2).alias(c) for c in LATENCY_COLUMNS])
    # A service without any latency has no quantiles and stays.
    return _ordered(match(volume, rounded, keys, "left"), keys)


def service_sla_approx(
    events: DataFrame, keys: Sequence[str] = ("service_name",), accuracy: int = 10_000
) -> DataFrame:
    """The same columns from a mergeable quantile sketch: one pass, one small shuffle."""
    keys = list(keys)
    sketch = F.percentile_approx("latency_ms", list(PROBS), accuracy)
    grouped = (
        events.where(F.col("service_name").isNotNull())
        .groupBy(*keys)
        .agg(*_volume(), sketch.alias("_q"))
    )
    flat = grouped.select(
        "*", *[tidy(F.col("_q")[i], 2).alias(c) for i, c in enumerate(LATENCY_COLUMNS)]
    )
    return _ordered(flat, keys)


def sla_sketches(events: DataFrame, keys: Sequence[str] = ("service_name",), time_col: str = "ts") -> DataFrame:
    """One row per key and day that any span can be put together from: counts, sums and a latency sketch.

    The sketch is of the mergeable kind with a fixed size, so a stored day never needs its
    events again. Rows without a service are left out, as in the other forms.
    """
    return (
        events.where(F.col("service_name").isNotNull())
        .groupBy(*keys, F.to_date(time_col).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status_code") >= 500).alias("errors"),
            F.sum("cpu_percent").alias("cpu_sum"),
            F.count("cpu_percent").alias("cpu_count"),
            F.sum("memory_percent").alias("memory_sum"),
            F.count("memory_percent").alias("memory_count"),
            F.kll_sketch_agg_double("latency_ms", F.lit(SKETCH_K)).alias("latency_sketch"),
        )
    )


def rolled_up(sketches: DataFrame, keys: Sequence[str] = ("service_name",)) -> DataFrame:
    """SLA rows per key over all days of ``sketches``, from the stored rows alone."""
    total, errors = F.sum("requests"), F.sum("errors")
    grouped = sketches.groupBy(*keys).agg(
        total.alias("total_requests"),
        errors.alias("total_errors_5xx"),
        tidy((total - errors) / total * 100.0, 4).alias("availability_sla"),
        tidy(F.sum("cpu_sum") / F.sum("cpu_count"), 2).alias("avg_cpu_percent"),
        tidy(F.sum("memory_sum") / F.sum("memory_count"), 2).alias("avg_memory_percent"),
        F.kll_merge_agg_double("latency_sketch").alias("_sketch"),
    )
    known = F.kll_sketch_get_n_double("_sketch") > 0
    quantiles = [
        tidy(F.when(known, F.kll_sketch_get_quantile_double("_sketch", F.lit(p))), 2).alias(c)
        for p, c in zip(PROBS, LATENCY_COLUMNS, strict=True)
    ]
    return _ordered(grouped.select("*", *quantiles), keys)


def approx_within_bound(
    events: DataFrame, approx: DataFrame, accuracy: float = 10_000
) -> DataFrame:
    """service_name and, per quantile, whether its rank is as near as ``accuracy`` promises.

    One pass counts the latencies below and up to each estimate, rounded as the estimates
    are. A service without any latency has no estimate and null verdicts.
    """
    near = small_side(approx.select("service_name", *LATENCY_COLUMNS))
    latencies = events.select("service_name", tidy(F.col("latency_ms"), 2).alias("_ms"))
    rows = latencies.where("_ms is not null").join(near, "service_name")
    n = F.count(F.lit(1))
    found = []
    for share, c in zip(PROBS, LATENCY_COLUMNS, strict=True):
        below = F.count_if(F.col("_ms") < F.col(c)) / n
        upto = F.count_if(F.col("_ms") <= F.col(c)) / n
        # The estimate itself is one of the latencies, which may be off by one rank.
        slack = F.lit(1.0 / accuracy) + 1 / n
        found.append(((below <= share + slack) & (upto >= share - slack)).alias(f"{c}_close"))
    judged = rows.groupBy("service_name").agg(*found)
    return near.select("service_name").join(judged, "service_name", "left")


def service_sla_daily(
    events: DataFrame, time_col: str = "ts", split: bool | None = None
) -> DataFrame:
    """SLA metrics per service and day."""
    dated = events.withColumn("day", F.to_date(time_col))
    return service_sla(dated, ["service_name", "day"], split=split)
