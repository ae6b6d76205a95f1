"""How far the sources of a language are apart in their words: an exact audit.

Count vectors: each document becomes a sparse vector of term counts, the vocabulary of a
language being all its terms of at least ``MIN_DOCS`` documents, without a limit on its size.
Vectors are summed per (language, source), and the same sums tell the documents of each term,
so that one pass over the texts is enough and no vocabulary meets the driver or has to fit an
executor. Probabilities are scaled integers, and a pair of sources is evaluated from the entries
that are there: a term that a source lacks has one probability for the whole source, so absent
terms enter as counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import written

MIN_DOCS = 30
# Scale of probabilities, and what is added to every count.
SCALE, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
# Bytes of a text that are cut into terms at once, and entries of one row of a vector.
PIECE, ENTRIES = 1 << 20, 1 << 15
# A term is a run without ASCII characters other than letters: those become spaces, A-Z lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted_terms(text: str | None) -> Counter:
    """The terms of a whole text with their counts; beside them only a piece of it is held as terms."""
    data, at, found = (text or "").encode().translate(FOLD), 0, Counter()
    while at < len(data):
        # To the last space of a piece, or beyond it to the end of a longer term.
        end = data.rfind(b" ", at, at + PIECE) + 1 if len(data) - at > PIECE else len(data)
        if end <= at:
            end = data.find(b" ", at + PIECE) + 1 or len(data)
        found.update(data[at:end].split())
        at = end
    return found


VECTORS = "lang string, source string, terms array<string>, counts array<long>"
VECTOR_SCHEMA = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' sparse vectors; a vector of very many terms takes several rows."""
    rows, entries = [], 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c] for c in ("lang", "source", "text")), strict=True):
            found = counted_terms(text.as_py())
            terms, counts = list(found), list(found.values())
            for at in range(0, len(terms), ENTRIES):
                rows.append((lang.as_py(), source.as_py(), terms[at : at + ENTRIES], counts[at : at + ENTRIES]))
                entries += len(rows[-1][2])
                if entries >= ENTRIES:
                    yield vector_batch(rows)
                    rows, entries = [], 0
    yield vector_batch(rows)


def vector_batch(rows: list[tuple[str, str, list[bytes], list[int]]]) -> pa.RecordBatch:
    langs, sources, terms, counts = zip(*rows, strict=True) if rows else ((),) * 4
    text = pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
    columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), text, pa.array(counts, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, schema=VECTOR_SCHEMA)


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def vector_sums(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: the sums of a group's vectors, and in how many a term stands."""
    entry = F.explode(F.arrays_zip("terms", "counts")).alias("entry")
    return (
        named(docs)
        .mapInArrow(vectors, VECTORS)
        .select("lang", "source", entry)
        .groupBy("lang", "source", F.col("entry.terms").alias("term"))
        .agg(F.sum("entry.counts").alias("n"), F.count(F.lit(1)).alias("docs"))
    )


def scaled(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) without rounding."""
    exact = [c.cast("decimal(28,0)") for c in (n, total, terms)]
    above = F.lit(SCALE).cast("decimal(10,0)") * (exact[0] + PRIOR)
    return 1 + F.call_function("div", above.cast("decimal(38,0)"), (exact[1] + exact[2] * PRIOR).cast("decimal(38,0)"))


def group_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms) of the table.

    ``groups``: lang, source, terms (kept terms of the language), zero (a missing term's
    probability), one row per group. ``terms``: lang, source, term, p, q (the language's
    probability), one row per kept term that stands in the group.
    """
    every = written(vector_sums(docs), "vector-sums")
    vocabulary = written(
        every.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs)
        .drop("docs"),
        "vocabulary",
    )
    sums = written(every.drop("docs").join(vocabulary.hint("merge"), ["lang", "term"]), "term-sums")
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    ).select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("terms", F.lit(0)).cast("long").alias("terms"),
        "lang_total",
    )
    zero = F.when(F.col("terms") > 0, scaled(F.lit(0), F.col("total"), F.col("terms")))
    groups = written(groups.withColumn("zero", zero), "term-groups")
    terms = sums.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        scaled(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        scaled(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    return groups, written(terms, "group-terms")


def pair_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item, value: for each two sources of a language the sum of |p - q|.

    Over all terms of both sources, those that none has count |zero - zero|. A term of one
    source alone differs from that by an amount which its p and the other's zero give: equal
    p of a source are counted together. Only terms that both have meet in a join, once for
    each pair of sources; all pairs of sources are what is asked for.
    """
    one = groups.select("lang", F.col("source").alias("a"), "terms", F.col("zero").alias("a_zero"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b_zero"))
    pairs = one.join(two, "lang").where("a < b")
    alike = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = alike.join(
        groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero")), "lang"
    ).join(groups.select("lang", "source", "zero"), ["lang", "source"]).where("source <> other")
    alone = alone.select(
        "lang",
        F.least("source", "other").alias("a"),
        F.greatest("source", "other").alias("b"),
        F.expr("times * (abs(p - other_zero) - abs(zero - other_zero))").alias("more"),
    )
    zeros = groups.select("lang", "source", "zero")
    have = terms.join(zeros, ["lang", "source"])
    left = have.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("a_p"), F.col("zero").alias("a_zero"))
    right = have.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("b_p"), F.col("zero").alias("b_zero"))
    both = left.join(right.hint("merge"), ["lang", "term"]).where("a < b")
    both = both.select(
        "lang",
        "a",
        "b",
        F.expr("abs(a_p - b_p) - abs(a_p - b_zero) - abs(b_p - a_zero) + abs(a_zero - b_zero)").alias("more"),
    )
    extra = alone.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    value = F.expr("coalesce(terms * abs(a_zero - b_zero), 0) + coalesce(more, 0)")
    found = pairs.join(extra, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("long").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.select("lang", way.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language with the distance to it. Part ``term``:
    the ``top`` terms that the source has more of than its language. Null text, lang and source
    are empty strings; a document without terms still makes its group occur. A language
    without kept terms has distances 0. Repeated rows are documents of their own; equal values
    are ranked by item; an empty table gives no rows; other columns are ignored. Texts of any
    length are cut into terms in pieces.
    """
    groups, terms = group_terms(docs, min_docs)
    pairs = ranked(written(pair_values(groups, terms), "pair-values"), "pair")
    over = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # The limit on the rank is applied in each task before rows travel.
    return pairs.unionByName(ranked(over, "term").where(F.col("rank") <= top))
