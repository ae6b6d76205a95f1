"""Secret scan with corpus-wide ownership, in DataFrame operations only.

Three patterns give candidate spans. A pattern's places come from two linear passes: the text
split at its matches gives the lengths between them, and a running sum gives their starts.
Every candidate's value is hashed and counted over distinct repositories and owners of the
whole corpus: values that many owners or many repositories have are copied examples, values of
a single owner in few repositories that look random are reported as live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.common import digest_key, whole_text, written

# kind -> (pattern, group with the value, shortest value). Patterns of maximal runs carry their
# least length; assignments are matched first and dropped afterwards if too short.
KINDS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# Kinds that ownership adds, listed after the base kinds.
ADDED = ("live", "example")
ORDER = (*KINDS, *ADDED)
# Owners or repositories from which on a value is an example that people copy.
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 4
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your[_-]|xxxx|0000000|1234567"
# Different characters that a random-looking value has at least.
VARIETY = 8


def found_in(kind: str) -> Column:
    """For each match the length of the text before it, its own length and its value.

    The last entry is the text after the last match; null where there is no match.
    """
    pattern, group, _ = KINDS[kind]
    text = F.col("body")
    some = text.rlike(pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(matches, F.length)
    parts = F.arrays_zip(gaps.alias("gap"), lengths.alias("length"), values.alias("value"))
    return F.when(some, parts).alias(kind)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a key per row of ``docs``; kind, start, end, digest and looks of its candidates."""
    body = docs.select(
        "doc_id", owner.alias("owner"), repository.alias("repository"), whole_text().alias("body")
    )
    key = digest_key(F.col("doc_id"), F.col("owner"), F.to_json(F.struct("repository")), F.col("body"))
    rows = written(
        body.select(
            key.alias("key"), "doc_id", "owner", "repository", *map(found_in, KINDS)
        ),
        "scan",
    )
    hit = rows.where(" or ".join(f"{k} is not null" for k in KINDS)).drop("doc_id").dropDuplicates(["key"])
    parts = [
        hit.where(F.col(kind).isNotNull()).select(
            "key", "owner", "repository", F.lit(kind).alias("kind"), F.posexplode(kind).alias("place", "part")
        )
        for kind in KINDS
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ahead = Window.partitionBy("key", "kind").orderBy("place")
    end = F.sum(F.col("part.gap") + F.coalesce(F.col("part.length"), F.lit(0))).over(ahead)
    least = F.element_at(F.create_map(*[F.lit(x) for k, (_, _, n) in KINDS.items() for x in (k, n)]), F.col("kind"))
    value = F.col("part.value")
    spans = (
        every.withColumn("end", end)
        .where(value.isNotNull() & (F.length(value) >= least))
        .select(
            "key",
            "owner",
            "repository",
            "kind",
            (F.col("end") - F.col("part.length")).alias("start"),
            "end",
            (F.col("end") - F.length(value)).alias("value_start"),
            F.sha2(value, 256).alias("digest"),
            looks_random(value).alias("random"),
        )
    )
    return rows.select("key", "doc_id"), written(spans, "spans")


def looks_random(value: Column) -> Column:
    variety = F.size(F.array_distinct(F.split(value, "")))
    return (variety >= VARIETY) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def ownership(spans: DataFrame) -> DataFrame:
    """digest, owners, repositories: over the whole corpus, counted in two steps.

    The first step leaves one row per (digest, owner, repository), however often a value was copied.
    """
    held = spans.select("digest", "owner", "repository").distinct()
    owners = held.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")
    )


def scanned(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs``.

    By default a document's owner is its source and its repository the source and language;
    null ones are an owner and a repository of their own. A null text is empty. Rows without
    spans have zero counts, the digest of the empty string and an empty list. Repeated rows
    give repeated results and count as one use; an empty table gives none. Other columns are
    ignored. Spans are in code points, end exclusive; ``live`` and ``example`` spans cover
    the value alone.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    rows, spans = candidates(docs, owner, repository)
    owned = written(ownership(spans), "ownership")
    wide = (F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)
    live = (F.col("owners") == 1) & F.col("random")
    added = (
        spans.join(owned, "digest")
        .withColumn("kind", F.when(wide, "example").when(live, "live"))
        .where("kind is not null")
        .select("key", "kind", F.col("value_start").alias("start"), "end")
    )
    listed = spans.select("key", "kind", "start", "end").unionByName(added)
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    per_row = listed.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", place.alias("place"), "kind", "end"))).alias("all")
    )
    base = F.filter("all", lambda s: s["place"] <= len(KINDS))
    counts = [
        F.size(F.filter("all", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    per_row = per_row.select(
        "key", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans")
    )
    zero = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.join(written(per_row, "per-row"), "key", "left").select(
        "doc_id",
        *zero,
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
