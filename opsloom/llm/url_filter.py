"""URL filter: host and path rules, and boosted trees over lexical features for the rest.

Everything is a DataFrame expression or a Spark ML estimator: no Python runs in a task. The
trees learn from labelled URLs, a bounded sample of them; the suffix statistics among their
features count all labelled URLs, in a fixed number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, rule): a rule is a host and, from its first slash, the beginning of a path.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
# Labelled URLs of each verdict that the trees are fitted to: the bound of the fit.
SAMPLE = 4000
# Buckets of the suffix statistics for one and for two host labels: bounds of what is broadcast.
BUCKETS = {1: 4096, 2: 65536}
# Weight of the overall share of blocked URLs in a suffix's share.
PRIOR = 4
TREES, DEPTH, SEED = 20, 4, 12
CUT = 0.5


def with_host(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path (in place of such columns): empty for a null or for a URL without ``://``."""
    urls = urls.drop("host", "path")
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    ends = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(ends) + 1, F.length(rest)), r"^[^?#]*", 0)
    return urls.select(
        "*", F.coalesce(F.translate(ends, UPPER, LOWER), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )


def rule_for(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of a host and path: the longest rule that fits, equal lengths by code points."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, start = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, how).otherwise(verdict)
    return rule, verdict


def entropy(column: Column) -> Column:
    """Bits per character, from the number of times that each different character stands there."""
    n = F.length(column).cast("double")
    shares = F.transform(
        F.array_distinct(F.split(column, "")), lambda c: (n - F.length(F.replace(column, c, F.lit("")))) / n
    )
    bits = F.aggregate(
        F.filter(shares, lambda s: s > 0), F.lit(0.0), lambda total, s: total - s * F.log2(s)
    )
    return F.when(n > 0, bits).otherwise(0.0)


def count_of(column: Column, letters: str) -> Column:
    """Characters of ``column`` that a character class matches."""
    return F.length(column) - F.length(F.regexp_replace(column, letters, ""))


def suffix(labels: int) -> Column:
    """Bucket of the host's last labels."""
    last = F.substring_index("host", ".", -labels)
    return F.pmod(F.xxhash64(last), F.lit(BUCKETS[labels])).cast("int")


LEXICAL = (
    "url_length host_length path_length depth digit_ratio letter_ratio url_entropy host_entropy "
    "parameters query_length labels hyphens has_fragment is_secure longest_number host_digits"
).split()
SUFFIX = [f"{what}_{k}" for k in BUCKETS for what in ("blocked", "seen")]


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features of ``with_host``'s rows and the buckets of their suffixes."""
    whole = F.coalesce(F.col(url), F.lit(""))
    length = F.greatest(F.length(whole), F.lit(1))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    number = lambda part: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(part, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0))
    found = {
        "url_length": F.length(whole),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "digit_ratio": count_of(whole, "[0-9]") / length,
        "letter_ratio": count_of(whole, "[A-Za-z]") / length,
        "url_entropy": entropy(whole),
        "host_entropy": entropy(F.col("host")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "query_length": F.length(query),
        "labels": F.size(F.filter(F.split("host", r"\."), lambda s: s != "")),
        "hyphens": count_of(F.col("host"), "-"),
        "has_fragment": whole.contains("#").cast("int"),
        "is_secure": whole.startswith("https://").cast("int"),
        "longest_number": number(F.col("path")),
        "host_digits": count_of(F.col("host"), "[0-9]"),
    }
    return urls.select(
        "*", *[found[c].cast("double").alias(c) for c in LEXICAL], *[suffix(k).alias(f"bucket_{k}") for k in BUCKETS]
    )


class Statistics:
    """How often URLs of a suffix were blocked, over all labelled URLs."""

    def __init__(self, labelled: DataFrame):
        total = labelled.agg(F.avg("label").alias("share")).first()
        self.share = float(total["share"] if total["share"] is not None else 0.0)
        self.tables = {
            k: written(
                labelled.groupBy(f"bucket_{k}").agg(
                    ((F.sum("label") + PRIOR * self.share) / (F.count(F.lit(1)) + PRIOR)).alias(f"blocked_{k}"),
                    F.log1p(F.count(F.lit(1))).alias(f"seen_{k}"),
                ),
                f"suffixes-{k}",
            )
            for k in BUCKETS
        }

    def add(self, urls: DataFrame) -> DataFrame:
        """The tables have at most as many rows as there are buckets, so each executor gets them."""
        for k, table in self.tables.items():
            urls = urls.join(F.broadcast(table), f"bucket_{k}", "left").fillna(
                {f"blocked_{k}": self.share, f"seen_{k}": 0.0}
            )
        return urls


class UrlFilter:
    """Boosted trees fitted to ``labelled`` (url, label: 1 block, 0 allow; other labels are left out).

    The trees see at most ``SAMPLE`` URLs of each label, distinct ones and chosen by a hash of
    the URL. Without labelled URLs of both kinds every URL gets the one label there is, or 0.
    """

    def __init__(self, labelled: DataFrame):
        usable = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("double").alias("label"))
        rows = written(lexical(with_host(usable)), "labelled-urls")
        self.statistics = Statistics(rows)
        counts = {r["label"]: r["n"] for r in rows.select("url", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.constant = None if len(counts) == 2 else float(max(counts, default=0.0))
        if self.constant is not None:
            return
        whole = 1 << 30
        share = F.when(F.col("label") == 1, self.part(counts[1.0], whole)).otherwise(self.part(counts[0.0], whole))
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(whole)) < share).dropDuplicates(["url", "label"])
        sample = written(self.statistics.add(drawn), "url-sample")
        # In one order at every run, whatever the tasks that wrote it.
        ordered = self.vectors(sample).select("vector", "label", "url").orderBy("url", "label").coalesce(1)
        trees = GBTClassifier(
            featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED
        )
        self.model = trees.fit(written(ordered, "url-vectors"))

    @staticmethod
    def part(rows: int, whole: int) -> int:
        return whole if rows <= SAMPLE else int(SAMPLE / rows * whole)

    @staticmethod
    def vectors(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="vector").transform(rows)

    def scored(self, urls: DataFrame) -> DataFrame:
        """Adds ``score``, the trees' probability of block, to rows of ``with_host``."""
        if self.constant is not None:
            return urls.withColumn("score", F.lit(self.constant))
        row = F.struct(*[c for c in urls.columns if c != "score"]).alias("row")
        rows = self.vectors(self.statistics.add(lexical(urls.select(row, "url", "host", "path"))))
        score = vector_to_array("probability")[1].alias("score")
        return self.model.transform(rows).select("row.*", score)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``.

    A URL's verdict is that of the longest rule that fits, else the trees': block from a score
    of ``CUT``. They learn from ``labelled`` (url, label), by default from the URLs of the table
    that a rule decides. A null URL has empty host and path, no rule, and the score of an empty
    text. Repeated rows get equal results; an empty table gives none; other columns are ignored.
    """
    rule, verdict = rule_for(rules)
    rows = with_host(pages.select("page_id", "url")).select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    found = UrlFilter(labelled).scored(rows)
    own = F.when(F.col("score") >= CUT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
