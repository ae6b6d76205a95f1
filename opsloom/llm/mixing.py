"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is cut into blocks of equally many words. A source gets a block for each of its
quotients target / (k - 1/2) among the highest ones, so quotas are integers that follow the
targets. A quota of one or more whole passes takes every document that often; the rest is
taken in an order drawn from a seed, block after block, the last document in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import WORD, whole_text, written
from opsloom.plans.sizing import small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
# Blocks in the whole mix at least, and in the smallest target above zero: the finer, the closer
# a source comes to its target. Blocks of two words are fine enough unless a target is smaller.
BLOCKS = 65536
LEAST_BLOCKS = 64
FINE_WORDS = 2
SEED = "mix-1"
# Hexadecimal digits of the drawn order that make a bucket; only one bucket a source is ordered.
BUCKET_DIGITS = 3


def sized(docs: DataFrame) -> DataFrame:
    """The documents with their number of words and their place in the drawn order."""
    drawn = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    return docs.withColumns({"size": size, "drawn": drawn})


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> the same with the target: capped shares, the excess reshared by weight.

    One row per source. Sources below their cap get words in proportion to their weight;
    those are the ones whose cap per weight exceeds the common level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select(
        "source", "source_size", ((F.row_number().over(order) - 1) % len(WEIGHTS)).alias("place")
    )
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") + 1)
    ranked = ranked.select(
        "source",
        "source_size",
        weights.alias("weight"),
        (F.col("source_size") * MOST_PASSES).alias("cap"),
        F.sum("source_size").over(Window.partitionBy()).alias("all_words"),
    )
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (
        F.col("all_words") * F.lit(SHARE)
        - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level)
    common = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(
        Window.partitionBy()
    )
    return levels.withColumn("common", common).select(
        "source",
        "source_size",
        F.least(F.col("weight") * F.col("common"), F.col("cap").cast("double")).alias("target"),
        "all_words",
    )


def quotas(goals: DataFrame) -> DataFrame:
    """source, source_size, target -> with ``quota`` words: whole blocks by highest quotients.

    Near the divisor (a block's words) only quotients that can change sides are ranked: those
    around target / block, by as many as rounding all sources could shift.
    """
    every = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    whole = F.ceil(F.col("all_words") * F.lit(SHARE) / BLOCKS)
    fine = F.greatest(F.floor(least / LEAST_BLOCKS), F.least(F.lit(FINE_WORDS), F.floor(least)))
    block = F.greatest(F.lit(1), F.least(whole, fine))
    known = goals.withColumn("block", block).withColumn("mix", F.sum("target").over(every))
    near = known.withColumn("seats", F.floor(F.col("target") / F.col("block"))).withColumn(
        "reach",
        F.lit(2) + F.ceil(F.count(F.lit(1)).over(every) * F.col("target") / F.greatest("mix", F.lit(1.0))),
    )
    near = near.withColumn("sure", F.greatest(F.lit(0), F.col("seats") - F.col("reach")))
    near = near.withColumn(
        "open", F.floor(F.col("mix") / F.col("block") + 0.5) - F.sum("sure").over(every)
    )
    seats = near.withColumn(
        "k", F.explode(F.expr("sequence(cast(sure + 1 as bigint), cast(seats + reach as bigint))"))
    ).withColumn("quotient", F.col("target") / (F.col("k") - 0.5))
    won = (
        seats.withColumn(
            "rank",
            F.row_number().over(
                Window.orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "k")
            ),
        )
        .groupBy("source", "source_size", "target", "block", "sure")
        .agg(F.count(F.when(F.col("rank") <= F.col("open"), 1)).alias("won"))
    )
    words = (F.col("sure") + F.col("won")) * F.col("block")
    return won.select(
        "source",
        "source_size",
        "target",
        F.least(words, F.col("source_size") * MOST_PASSES).cast("long").alias("quota"),
    )


def mixed(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repeats included; it is at
    most twice its size. A null text has no words and gives none; a null source is a source
    of its own, after all others. Rows that repeat doc_id and size may swap their shares. The
    same rows give the same mix on every run. An empty table gives an empty mix. With
    ``whole_rows`` the row itself comes along as the struct ``row``.
    """
    carried = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    slim = written(sized(docs.select("doc_id", "text", "source", *carried)).drop("text"), "sized")
    buckets = written(
        slim.groupBy("source", bucket().alias("bucket")).agg(F.sum("size").alias("words")), "buckets"
    )
    per_source = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    some = F.col("source_size") > 0
    plan = quotas(targets(per_source)).select(
        "source",
        "source_size",
        "target",
        F.when(some, F.expr("quota div source_size")).otherwise(0).alias("passes"),
        F.when(some, F.col("quota") % F.col("source_size")).otherwise(0).alias("rest"),
    )
    known = small_side(written(with_cut(written(plan, "plan"), buckets), "cuts"))
    rows = (
        slim.alias("d")
        .join(known.alias("k"), F.expr("d.source <=> k.source"))
        .select("d.*", *[F.col(f"k.{c}") for c in known.columns if c != "source"])
    )
    order = Window.partitionBy("source").orderBy("drawn", "doc_id", "size")
    ahead = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    is_cut = bucket().eqNullSafe(F.col("cut"))
    in_part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("ahead")))
    in_full = F.when(bucket() < F.col("cut"), F.col("size")).otherwise(0)
    passes = F.col("passes") * F.col("size")
    shown = ["doc_id", "size", "source_size", "target", *(["row"] if whole_rows else [])]
    return (
        rows.where(~is_cut)
        .select(*shown, (passes + in_full).alias("taken"))
        .unionByName(
            rows.where(is_cut)
            .withColumn("ahead", ahead - F.col("size"))
            .select(*shown, (passes + in_part).alias("taken"))
        )
    )


def bucket():
    return F.substring("drawn", 1, BUCKET_DIGITS)


def with_cut(plan: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds the bucket in which a source's last, partial pass ends, and the words taken of it."""
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    cuts = (
        placed.alias("b")
        .join(plan.alias("p"), F.expr("b.source <=> p.source"))
        .where("before <= rest and rest < before + words")
        .select("b.source", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))
    )
    return (
        plan.alias("p")
        .join(cuts.alias("c"), F.expr("p.source <=> c.source"), "left")
        .select("p.source", "source_size", "target", "passes", "cut", "left")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, rounded to whole documents."""
    taken = mixed(docs, whole_rows=True).where("size > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
