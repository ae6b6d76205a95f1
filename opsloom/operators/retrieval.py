"""Lexical retrieval for a whole table of queries at once.

A search joins query terms with postings and sums per (query, document); nothing is looked up
per query on the driver. An index that is built on the fly tokenises the corpus once and
keeps the postings of asked words only. A stored index has its postings in folders of term
buckets, in blocks of one term and one slice of the documents, each with the greatest score
part in it: a search opens the asked buckets and leaves out slices whose blocks together
cannot reach the k-th best score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.barrier import evaluated_once
from opsloom.functions.text import tokens
from opsloom.plans.durable import durable, shuffles_freed, stored
from opsloom.plans.sizing import fits_one_task, planned_bytes, small_side

# BM25+ constants, the rank constant of the fusion and the answer texts.
K1 = 1.5
B = 0.75
DELTA = 1.0
RRF_K = 60
NO_RUNBOOK = "No matching runbook found."
HIT_SEPARATOR = "\n---\n"
OOM_EXPANSION = " CUDA Out of Memory memory leak heap allocation"
LATENCY_EXPANSION = " p95 p99 response time CPU throttling bottleneck"
CHUNK_SIZE = 400
CHUNK_OVERLAP = 50
SEPARATORS = ("\n\n", "\n", ". ", " ", "")

# Term buckets of a stored index, and documents of a slice.
BUCKETS = 64
SLICE_DOCS = 128
# Postings of rare words that are read, for each document asked for, to bound the k-th best score.
LEAD_POSTINGS = 200
# Scanned bytes of a corpus whose words one task counts.
COUNT_BYTES = 16 * 1024 * 1024
# Estimates from here on mean that Spark does not know.
UNKNOWN_BYTES = 1 << 50
# Meetings of a query's word and a document that one task adds up.
MEETINGS = 2_000_000
# Bounds are compared with more room than rounding takes.
SLACK = 1e-8
# Scores closer than this are the same score; order of summation must not rank documents.
SCORE_DIGITS = 9


@dataclass
class Postings:
    """Postings of asked words (doc_id, doc_len, doc_terms, term, tf), their terms (term, doc_freq),
    and the corpus totals."""

    rows: DataFrame
    terms: DataFrame
    n_docs: Column
    mean_len: Column


@dataclass
class CorpusIndex:
    """A corpus to be searched once: documents (doc_id, doc_len, doc_terms) and their tokens."""

    words: DataFrame

    @property
    def documents(self) -> DataFrame:
        return self.words.drop("_tokens")

    def counted(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """Postings and, with a null term, one row per document; written, so that tokens are cut once.

        ``explode_outer`` and a filter on its result, here and below: for a plain ``explode``
        Spark infers a filter on the array and evaluates the tokeniser again, below any shuffle.
        """
        marked = F.concat(F.coalesce("_tokens", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
        rows = self.words.select("doc_id", "doc_len", "doc_terms", F.explode_outer(marked).alias("term"))
        if vocabulary is not None:
            asked = vocabulary.withColumnRenamed("term", "_asked")
            rows = rows.join(asked, F.col("term") == F.col("_asked"), "left").where("term is null or _asked is not null")
        counts = rows.groupBy("doc_id", "doc_len", "doc_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
        return durable(counts)

    def postings(self, vocabulary: DataFrame) -> Postings:
        counted = self.counted(vocabulary)
        rows = counted.where("term is not null")
        totals = counted.where("term is null").agg(F.sum("tf").alias("n"), (F.sum(F.col("doc_len") * F.col("tf")) / F.sum("tf")).alias("mean"))
        return Postings(rows, term_table(rows), totals.select("n").scalar(), totals.select("mean").scalar())


def spread_texts(docs: DataFrame, text: str) -> DataFrame:
    """Texts in tasks of bounded size: counting a scan split's words takes many times the split's bytes."""
    size = planned_bytes(docs)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if size is None or size <= cores * COUNT_BYTES or size >= UNKNOWN_BYTES:
        return docs
    # By the text: rows that share an id, or have none, are spread as well.
    return docs.repartition(-(-size // COUNT_BYTES), text, *[c for c in docs.columns if c != text])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> CorpusIndex:
    docs = spread_texts(docs.select(doc_id, text), text)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_tokens"))
    return CorpusIndex(
        words.select(
            "doc_id",
            F.size("_tokens").alias("doc_len"),
            F.size(F.array_distinct("_tokens")).alias("doc_terms"),
            "_tokens",
        )
    )


def term_table(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_tf")
    )


def bm25_part(doc_len: Column, tf: Column, mean_len: Column) -> Column:
    """What a term adds to a document's score, for a weight of 1."""
    return tf * (K1 + 1) / (K1 * (1 - B + B * doc_len / mean_len) + tf)


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_tasks(words: DataFrame) -> int:
    """Tasks that put an index together: each holds the words of about ``COUNT_BYTES`` of stored tokens."""
    size = planned_bytes(words)
    cores = words.sparkSession.sparkContext.defaultParallelism
    return cores if size is None or size >= UNKNOWN_BYTES else max(cores, -(-size // COUNT_BYTES))


def write_index(index: CorpusIndex, path: str, slice_docs: int = SLICE_DOCS) -> None:
    """Stores blocks and terms in folders of term buckets, documents, and the totals.

    A slice is a share of the documents by hash, of about ``slice_docs``, so no block grows
    with the corpus, and a word of a third of all documents lies in many files of its bucket.
    """
    # Tokens are cut once and kept as one text, a third of an array's size in a shuffle; then each task gets whole slices, so that words are counted and blocks
    # are put together where the texts are, without a shuffle of the postings.
    words = index.words.withColumn("_tokens", F.array_join("_tokens", " "))
    words = stored(words, "words", "zstd")
    spark = words.sparkSession
    documents = words.groupBy("doc_id", "doc_len", "doc_terms").agg(F.count(F.lit(1)).alias("tf"))
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    totals = spark.read.parquet(f"{path}/documents").agg(
        F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("doc_len") * F.col("tf")) / F.sum("tf"), F.lit(0.0)).alias("mean_len"),
    )
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    known = spark.read.parquet(f"{path}/totals").first()
    slices = max(1, -(-known["n_docs"] // slice_docs))
    dealt = words.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).repartition(index_tasks(words), "slice")
    counted = (
        dealt.select("slice", "doc_id", "doc_len", "doc_terms", F.explode_outer(F.split("_tokens", " ")).alias("term"))
        .where("term <> ''")
        .groupBy("slice", "doc_id", "doc_len", "doc_terms", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    rows = counted.select(
        "slice",
        "term",
        "tf",
        F.struct("doc_id", "doc_len", "doc_terms", "tf").alias("posting"),
        bm25_part(F.col("doc_len"), F.col("tf"), F.lit(known["mean_len"])).alias("part"),
    )
    blocks = rows.groupBy("slice", "term").agg(
        F.max("part").alias("max_part"),
        F.count(F.lit(1)).alias("doc_freq"),
        F.sum("tf").alias("total_tf"),
        F.collect_list("posting").alias("postings"),
    )
    blocks = blocks.withColumn("bucket", term_bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "slice")
    with shuffles_freed(spark):
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks", compression="zstd")
    # The blocks' own counts: their postings are not read again.
    terms = spark.read.parquet(f"{path}/blocks").groupBy("bucket", "term").agg(
        F.sum("doc_freq").alias("doc_freq"), F.sum("total_tf").alias("total_tf"), F.max("max_part").alias("max_part")
    )
    terms = terms.repartition("bucket").sortWithinPartitions("bucket", "term")
    with shuffles_freed(spark):
        terms.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


@dataclass
class StoredIndex:
    """A written index; a search opens only the folders of the buckets that it asks for."""

    blocks: DataFrame
    terms: DataFrame
    documents: DataFrame
    n_docs: int
    mean_len: float

    def asked(self, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(blocks, terms) of the asked words."""
        found = vocabulary.select(term_bucket(F.col("term")).alias("bucket")).distinct().collect()
        here = F.col("bucket").isin(*[r["bucket"] for r in found])
        return tuple(t.where(here).join(vocabulary, "term", "left_semi") for t in (self.blocks, self.terms))

    def postings(self, vocabulary: DataFrame) -> Postings:
        blocks, terms = self.asked(vocabulary)
        rows = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*")
        return Postings(rows, terms.select("term", "doc_freq"), F.lit(self.n_docs), F.lit(self.mean_len))


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    blocks, terms, documents = (spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "documents"))
    blocks = blocks.drop("doc_freq", "total_tf")
    totals = spark.read.parquet(f"{path}/totals").first()
    return StoredIndex(blocks, terms, documents.drop("tf"), totals["n_docs"], totals["mean_len"])


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query_terms, term, qtf) from (query_id, query)."""
    words = queries.select("query_id", tokens(F.col("query")).alias("_t"))
    return (
        words.select(
            "query_id", F.size(F.array_distinct("_t")).alias("query_terms"), F.explode_outer("_t").alias("term")
        )
        .where("term is not null")
        .groupBy("query_id", "query_terms", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def weighted(words: DataFrame, terms: DataFrame, n_docs: Column) -> DataFrame:
    """``words`` that the corpus knows, with their BM25+ weight."""
    known = words.join(terms, "term")
    return known.withColumn("weight", F.col("qtf") * F.log((n_docs + 1) / F.col("doc_freq")))


def together(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings with all words of a document in one task, so that pairs are added up where they arise.

    Pairs outnumber postings by far: they are not shuffled. The number of tasks follows
    the meetings that the join will make, so what one task holds does not grow with the corpus.
    """
    meetings = asked.agg(F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-meetings // MEETINGS))
    return rows.repartition(tasks, "doc_id")


def match_scores(queries: DataFrame, index: CorpusIndex | StoredIndex) -> DataFrame:
    """BM25+ and overlap score of every (query, document) pair that shares a term.

    Both scores come from one join and one aggregation. BM25+ credits each query term the
    corpus knows with idf x delta even where the document lacks it; that part is a constant
    of the query and is added at the end.
    """
    words = query_terms(queries)
    found = index.postings(small_side(words.select("term").distinct()))
    asked = small_side(durable(weighted(words, found.terms.select("term", "doc_freq"), found.n_docs)))
    floor = asked.groupBy("query_id").agg((F.sum("weight") * DELTA).alias("floor"))
    part = F.col("weight") * bm25_part(F.col("doc_len"), F.col("tf"), F.col("mean_len"))
    pairs = (
        together(found.rows, asked)
        .withColumn("mean_len", found.mean_len)
        .join(asked.select("query_id", "query_terms", "term", "weight"), "term")
        .groupBy("query_id", "doc_id")
        .agg(
            F.sum(part).alias("matched"),
            F.count(F.lit(1)).alias("shared"),
            F.first("query_terms").alias("query_terms"),
            F.first("doc_terms").alias("doc_terms"),
        )
    )
    return pairs.join(small_side(floor), "query_id").select(
        "query_id",
        "doc_id",
        F.round(F.col("matched") + F.col("floor"), SCORE_DIGITS).alias("bm25"),
        F.round(
            F.col("shared") / F.sqrt((F.col("query_terms") * F.col("doc_terms")).cast("double")), SCORE_DIGITS
        ).alias("overlap"),
    )


def _top(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best documents per query; Spark keeps k rows per task before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = scored.select("query_id", "doc_id", F.col(score).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(queries: DataFrame, index: CorpusIndex | StoredIndex, k: int = 5) -> DataFrame:
    """Top documents by BM25+; only documents sharing a term are returned."""
    if isinstance(index, StoredIndex):
        return block_max_search(queries, index, k)
    return _top(match_scores(queries, index), "bm25", k)


def block_max_search(queries: DataFrame, index: StoredIndex, k: int) -> DataFrame:
    """The same rows from a stored index, leaving out blocks that cannot matter."""
    asked, blocks = asked_blocks(queries, index)
    floor = asked.groupBy("query_id").agg((F.sum("weight") * DELTA).alias("floor"))
    open_ = open_slices(asked, blocks, index.mean_len, k)
    # Whole slices to tasks: pairs outnumber the postings by far, and are added up where they arise.
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-(planned_bytes(index.blocks) or 0) // COUNT_BYTES))
    at = open_.groupBy("slice").agg(F.collect_set("query_id").alias("_open")).repartition(tasks, "slice")
    dealt = blocks.select("slice", "term", "postings").repartition(tasks, "slice").join(at.hint("shuffle_hash"), "slice")
    wanted = dealt.join(asked.select("query_id", "term", "weight"), "term").where("array_contains(_open, query_id)")
    scored = (
        posting_parts(wanted, index.mean_len, "slice")
        .groupBy("slice", "query_id", "doc_id")
        .agg(F.sum("part").alias("matched"))
        .join(F.broadcast(floor) if fits_one_task(floor) else floor, "query_id")
        .select("query_id", "doc_id", F.round(F.col("matched") + F.col("floor"), SCORE_DIGITS).alias("bm25"))
    )
    return _top(scored, "bm25", k)


def asked_blocks(queries: DataFrame, index: StoredIndex) -> tuple[DataFrame, DataFrame]:
    """(asked, blocks): the queries' weighted words, and the blocks of those words."""
    words = query_terms(queries)
    blocks, terms = index.asked(small_side(words.select("term").distinct()))
    known = weighted(words, terms.select("term", "doc_freq"), F.lit(index.n_docs))
    return small_side(durable(known)), blocks


def posting_parts(blocks: DataFrame, mean_len: float, *others: str) -> DataFrame:
    """query_id, doc_id, part of every posting of blocks that carry a query's weight, and ``others``."""
    part = F.col("weight") * bm25_part(F.col("p.doc_len"), F.col("p.tf"), F.lit(mean_len))
    return blocks.select(*others, "query_id", "weight", F.explode("postings").alias("p")).select(
        *others, "query_id", "p.doc_id", part.alias("part")
    )


def open_slices(asked: DataFrame, blocks: DataFrame, mean_len: float, k: int) -> DataFrame:
    """(query_id, slice) that may hold one of the k best documents.

    The sums over a query's rarest words alone are lower bounds of scores, so the k-th best of
    them is one of the k-th best score. A slice whose greatest parts add up to less holds
    nothing that is asked for. Only the blocks of the rare words are opened for this.
    """
    before = W.partitionBy("query_id").orderBy("doc_freq", "term").rowsBetween(W.unboundedPreceding, -1)
    rare = asked.withColumn("_before", F.coalesce(F.sum("doc_freq").over(before), F.lit(0))).where(
        F.col("_before") < LEAD_POSTINGS * k
    )
    low = (
        posting_parts(blocks.join(rare.select("query_id", "term", "weight"), "term"), mean_len)
        .groupBy("query_id", "doc_id")
        .agg(F.sum("part").alias("low"))
    )
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))
    least = low.withColumn("_n", best).where(F.col("_n") == k).select("query_id", (F.col("low") - SLACK).alias("least"))
    # Fewer than k documents with a rare word: no bound, every slice stays.
    greatest = (
        blocks.select("term", "slice", "max_part")
        .join(asked.select("query_id", "term", "weight"), "term")
        .groupBy("query_id", "slice")
        .agg(F.sum(F.col("weight") * F.col("max_part")).alias("most"))
    )
    kept = greatest.join(least, "query_id", "left").where("least is null or most >= least")
    return stored(kept.select("query_id", "slice"), "open-slices")


def overlap_search(queries: DataFrame, index: CorpusIndex, k: int = 5) -> DataFrame:
    """Top documents by token-set cosine, filled with zero-score documents in document order.

    Of the first k documents at most as many are already ranked as the query has matches,
    so they always suffice as fillers.
    """
    top = _top(match_scores(queries, index), "overlap", k)
    counts = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    first = index.documents.select("doc_id").orderBy("doc_id").limit(k)
    first_ids = first.agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    short = (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .select("query_id", F.coalesce("found", F.lit(0)).alias("found"))
        .where(F.col("found") < k)
        .withColumn("_ids", first_ids.select("ids").scalar())
    )
    w = W.partitionBy("query_id").orderBy("doc_id")
    fill = (
        short.select("query_id", "found", F.explode("_ids").alias("doc_id"))
        .join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        .withColumn("rank", F.row_number().over(w) + F.col("found").cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank")
    )
    return top.unionByName(fill)


def rrf_search(
    queries: DataFrame, index: CorpusIndex | StoredIndex, k: int = 5, rrf_k: int = RRF_K
) -> DataFrame:
    """Reciprocal rank fusion of both rankings, without sorting either of them as a whole.

    The k first documents of one list have at least 1 / (rrf_k + k), and a document beyond
    rank rrf_k + 2k in both lists has less. So the beginnings of both lists hold every document
    that is asked for. Of those, the ones that may still be among the k best and whose rank
    in the other list is not known yet are compared with all pairs: the number of pairs ahead
    is the rank.
    """
    scored = stored(match_scores(queries, index), "pairs")
    depth = rrf_k + 2 * k
    lists = {"bm25": "sparse_rank", "overlap": "dense_rank"}
    # Both lists in one pass over the pairs.
    entries = F.array(*[F.struct(F.lit(rank).alias("list"), F.col(by).alias("by")) for by, rank in lists.items()])
    best = W.partitionBy("query_id", "list").orderBy(F.desc("by"), "doc_id")
    first = (
        scored.select("query_id", "doc_id", *lists, F.inline(entries))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= depth)
    )
    ranks = [F.max(F.when(F.col("list") == r, F.col("rank"))).alias(r) for r in lists.values()]
    both = durable(first.groupBy("query_id", "doc_id", *lists).agg(*ranks))
    share = lambda rank: 1.0 / (rrf_k + rank)
    least = sum((F.coalesce(share(F.col(r)), F.lit(0.0)) for r in lists.values()), F.lit(0.0))
    most = sum((share(F.coalesce(r, F.lit(depth + 1))) for r in lists.values()), F.lit(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc("least"))
    bound = both.withColumn("least", least).withColumn("_n", F.row_number().over(order))
    bound = bound.groupBy("query_id").agg(F.max(F.when(F.col("_n") == k, F.col("least"))).alias("bound"))
    kept = both.join(bound, "query_id").where(F.col("bound").isNull() | (most >= F.col("bound") - SLACK)).drop("bound")
    kept = durable(kept)
    known = "sparse_rank is not null and dense_rank is not null"
    open_ = kept.where(f"not ({known})").select("query_id", F.col("doc_id").alias("_doc"), *[F.col(by).alias(f"_{by}") for by in lists])
    ahead = [
        F.count_if((F.col(by) > F.col(f"_{by}")) | ((F.col(by) == F.col(f"_{by}")) & (F.col("doc_id") < F.col("_doc"))))
        for by in lists
    ]
    # At most 2 x depth rows per query.
    counted = (
        scored.join(small_side(open_), "query_id")
        .groupBy("query_id", F.col("_doc").alias("doc_id"))
        .agg(*[(n + 1).cast("int").alias(r) for n, r in zip(ahead, lists.values(), strict=True)])
    )
    ranked = kept.where(known).select("query_id", "doc_id", *lists.values()).unionByName(counted)
    fused = sum((share(F.col(r)) for r in lists.values()), F.lit(0.0))
    return _top(ranked.withColumn("rrf", F.round(fused, 12)), "rrf", k)


def expand_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Each query followed by its expansions, with their position."""
    low = F.lower(text)
    variants = F.array_compact(
        F.array(
            F.col(text),
            F.when(low.contains("oom") | low.contains("memory"), F.concat(F.col(text), F.lit(OOM_EXPANSION))),
            F.when(
                low.contains("latency") | low.contains("slow"), F.concat(F.col(text), F.lit(LATENCY_EXPANSION))
            ),
        )
    )
    others = [c for c in queries.columns if c != text]
    return queries.select(*others, F.posexplode(variants).alias("variant", text))


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, doc_id: str = "doc_id",
    text: str = "text", source: str = "source",
) -> DataFrame:
    """Windows of ``size`` words that share ``overlap`` words with their predecessor.

    A word keeps the white space after it, so the windows together reproduce the text.
    """
    stride = size - overlap
    words = F.regexp_extract_all(F.col(text), F.lit(r"\S+\s*"), F.lit(0))
    split = evaluated_once(docs.select(doc_id, source, text), "_words", words)

    def window(i):
        part = F.slice("_words", i * stride + 1, F.lit(size))
        body = F.rtrim(F.array_join(part, ""))
        return F.struct(i.alias("chunk_index"), body.alias("chunk_text"), F.size(part).alias("token_count"))

    # The windows are cut inside the row; exploding first would copy all words per window.
    count = F.size("_words")
    last = F.ceil(F.greatest(F.lit(0), count - size) / F.lit(stride)).cast("int")
    windows = F.when(count > 0, F.transform(F.sequence(F.lit(0), last), window))
    chunks = split.select(doc_id, source, F.explode(windows).alias("_c")).select(doc_id, source, "_c.*")
    return chunks.withColumn("chunk_id", _chunk_id(source))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def recursive_chunks(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    length: Callable[[Column], Column] = word_count,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Chunks cut at the coarsest separators that make pieces shorter than ``size``.

    A text is cut before every occurrence of the first separator it holds; pieces that are
    still too long are cut by the next ones, the empty separator cutting between characters.
    Neighbouring short pieces of one cut are put together again up to ``size``, each chunk
    beginning with at most ``overlap`` of its predecessor's last pieces. ``length`` measures
    a piece as a column expression; lengths of pieces add up. Chunks are trimmed, empty ones
    left out. Null and empty texts have none.
    """
    piece, path = F.col(text).alias("_piece"), F.array().cast("array<int>").alias("_path")
    open_ = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), piece, path)
    pieces = []
    for level, separator in enumerate(separators):
        last = level == len(separators) - 1
        holds = F.col("_piece").contains(separator) if separator else F.lit(True)
        # The last separator cuts what none before it did, even if it does not occur.
        cut = open_.select("doc_id", "source", "_path", F.posexplode(_cut_before("_piece", separator)).alias("_at", "_piece"))
        if not last:
            cut = open_.where(holds).select(
                "doc_id", "source", "_path", F.posexplode(_cut_before("_piece", separator)).alias("_at", "_piece")
            )
        sized = evaluated_once(cut, "_length", length(F.col("_piece")))
        short = F.col("_length") < size
        pieces.append(sized.where(short | F.lit(last)).withColumn("_short", short))
        deeper = sized.where(~short).select("doc_id", "source", "_piece", F.array_append("_path", F.col("_at")).alias("_path"))
        open_ = deeper if last else open_.where(~holds).select("doc_id", "source", "_piece", "_path").unionByName(deeper)
    every = reduce(DataFrame.unionByName, pieces)
    # Pieces of one cut without a longer one in between are neighbours: their places run on.
    order = W.partitionBy("doc_id", "source", "_path", "_short").orderBy("_at")
    run = F.when(F.col("_short"), F.col("_at") - F.row_number().over(order)).otherwise(F.col("_at"))
    keys = ["doc_id", "source", "_path", "_short", "_run"]
    total = F.sum("_length").over(W.partitionBy(*keys).orderBy("_at")).cast("int").alias("_upto")
    runs = (
        every.withColumn("_run", run)
        .select(*keys, "_at", "_piece", total)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_piece", "_upto"))).alias("_pieces"))
    )
    bounds = _merged_bounds(F.transform("_pieces", lambda p: p["_upto"]), size, overlap)
    parts = runs.withColumn("_bounds", bounds).select(
        "doc_id",
        "source",
        F.array_append("_path", F.col("_pieces")[0]["_at"]).alias("_place"),
        F.posexplode(
            F.transform(
                "_bounds",
                lambda b: F.array_join(
                    F.transform(F.slice("_pieces", b["a"] + 1, b["b"] - b["a"]), lambda p: p["_piece"]), ""
                ),
            )
        ).alias("_no", "_text"),
    )
    trimmed = F.regexp_replace("_text", r"(?U)^\s+|\s+$", "").alias("chunk_text")
    kept = parts.select("doc_id", "source", "_place", "_no", trimmed).where("chunk_text <> ''")
    index = F.row_number().over(W.partitionBy("doc_id", "source").orderBy("_place", "_no")) - 1
    chunks = kept.select(
        F.col("doc_id").alias(doc_id),
        F.col("source").alias(source),
        index.alias("chunk_index"),
        "chunk_text",
        length(F.col("chunk_text")).cast("int").alias("token_count"),
    )
    return chunks.withColumn("chunk_id", _chunk_id(source))


def _cut_before(column: str, separator: str) -> Column:
    """The parts of a text, each but the first beginning with the separator; no empty ones."""
    if not separator:
        return F.filter(F.split(F.col(column), ""), lambda c: c != "")
    parts = F.split(F.col(column), rf"\Q{separator}\E", -1)
    kept = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p)))
    return F.filter(kept, lambda p: p != "")


def _merged_bounds(totals: Column, size: int, overlap: int) -> Column:
    """ARRAY<STRUCT<a, b>>: the pieces ``a`` to ``b`` (exclusive) of each chunk of a run.

    A fold over the pieces' running ``totals``, whose state is where the open chunk begins and
    the bounds of the closed ones. A chunk is closed by a piece that does not fit; the next
    begins with the closed one's last pieces, as many as ``overlap`` and the new piece leave
    room for.
    """

    def folded(sums: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            new = sums[i + 1] - sums[i]
            full = (sums[i + 1] - sums[state["start"]]) > size
            rest = lambda s: sums[i] - sums[s]
            fits = lambda s: (rest(s) <= overlap) & ((rest(s) + new <= size) | (rest(s) <= 0))
            start = F.array_min(F.filter(F.sequence(state["start"], i), fits))
            closed = F.array_append(state["closed"], F.struct(state["start"].alias("a"), i.alias("b")))
            return F.struct(
                F.when(full, start).otherwise(state["start"]).alias("start"),
                F.when(full & (i > state["start"]), closed).otherwise(state["closed"]).alias("closed"),
            )

        none = F.array().cast("array<struct<a:int,b:int>>")
        first = F.struct(F.lit(0).alias("start"), none.alias("closed"))
        count = F.size(sums) - 1
        steps = F.sequence(F.lit(0), count - 1)
        done = F.aggregate(
            steps, first, step, lambda s: F.array_append(s["closed"], F.struct(s["start"].alias("a"), count.alias("b")))
        )
        return done

    # Bound to a name: the totals are used in every step.
    return F.transform(F.array(F.concat(F.array(F.lit(0)), totals)), folded)[0]


def _chunk_id(source: str) -> Column:
    key = F.concat_ws(":", F.col(source), F.col("chunk_index").cast("string"), F.substring("chunk_text", 1, 30))
    return F.substring(F.sha2(key, 256), 1, 16)


def kb_answers(queries: DataFrame, docs: DataFrame, index: CorpusIndex, k: int = 2) -> DataFrame:
    """The best runbooks of each query as one text. At most k texts are joined per query."""
    hits = rrf_search(queries, index, k).join(docs.select("doc_id", "text"), "doc_id")
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("text"))
    joined = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_hits")
    )
    text = F.array_join(F.transform("_hits", lambda h: h["line"]), HIT_SEPARATOR)
    answers = joined.select("query_id", text.alias("answer"))
    return queries.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(NO_RUNBOOK)).alias("answer")
    )
