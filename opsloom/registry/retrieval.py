"""Retrieval queries: all documents, all benchmark items as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import retrieval
from opsloom.plans.durable import scratch_path
from opsloom.registry import Views, query

TOKENS = r"regexp_extract_all(lower({}), '[\p{L}\p{N}_]+')"


def tokens_sql(column: str) -> str:
    return TOKENS.replace("{}", column)


def index_sql(queries: str = "select item_id as query_id, text as query from benchmark") -> str:
    """CTEs doc, post, term, q, qt, pair: the scores of all matching pairs."""
    return f"""doc as (
      select doc_id, len(toks) as doc_len, len(list_distinct(toks)) as doc_terms, toks
      from (select doc_id, {tokens_sql("text")} as toks from documents)),
    post as (select doc_id, doc_len, doc_terms, term, count(*) as tf
      from (select doc_id, doc_len, doc_terms, unnest(toks) as term from doc) group by all),
    term as (select term, count(*) as doc_freq, cast(sum(tf) as bigint) as total_tf from post group by term),
    q as ({queries}),
    qt as (select query_id, query_terms, word, count(*) as qtf from (
      select query_id, len(list_distinct(toks)) as query_terms, unnest(toks) as word
      from (select query_id, {tokens_sql("query")} as toks from q)) group by all),
    asked as (select query_id, query_terms, term, qtf * ln(((select count(*) from doc) + 1) / doc_freq) as weight
      from qt join term on term.term = qt.word),
    flr as (select query_id, sum(weight) as floor_part from asked group by query_id),
    pair as (select query_id, doc_id, round(matched + floor_part, 9) as bm25,
        round(shared / sqrt(query_terms * doc_terms), 9) as overlap
      from (select query_id, doc_id, query_terms, doc_terms, count(*) as shared,
          sum(weight * tf * 2.5 / (1.5 * (0.25 + 0.75 * doc_len / (select avg(doc_len) from doc)) + tf)) as matched
        from post join asked using (term) group by all) join flr using (query_id))"""


RRF_SQL = """fused as (
      select query_id, doc_id, round(1.0 / (60 + row_number() over (partition by query_id order by bm25 desc, doc_id))
        + 1.0 / (60 + row_number() over (partition by query_id order by overlap desc, doc_id)), 12) as score
      from pair),
    hits as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fused)"""


def _queries(v: Views):
    return v.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _rounded(hits):
    return hits.withColumn("score", F.round("score", 6))


def _stored(v: Views):
    path = scratch_path(v.spark, "index")
    retrieval.write_index(retrieval.build_index(v.documents), path)
    return retrieval.read_index(v.spark, path)


@query("tokenize", f"select doc_id, array_to_string({tokens_sql('text')}, ' ') as tokens from documents")
def tokenize(v: Views):
    from opsloom.functions.text import tokens

    return v.documents.select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("corpus_index", f"with {index_sql()} select term, doc_freq, total_tf from term")
def corpus_index(v: Views):
    return _stored(v).terms.select("term", "doc_freq", "total_tf")


BM25_QUERY = f"""with {index_sql()} select query_id, doc_id, round(bm25, 6) as score, rank from (
      select *, row_number() over (partition by query_id order by bm25 desc, doc_id) as rank from pair)
    where rank <= 5"""


@query("bm25_search", BM25_QUERY)
def bm25_search(v: Views):
    return _rounded(retrieval.bm25_search(_queries(v), retrieval.build_index(v.documents)))


@query("bm25_search_stored", BM25_QUERY)
def bm25_search_stored(v: Views):
    """From a written index, leaving out blocks by their greatest score part."""
    return _rounded(retrieval.bm25_search(_queries(v), _stored(v)))


# Some of the queries share no word with any document, so that fillers are needed.
ODD_QUERIES = """select item_id as query_id, case when item_id % 4 = 0 then 'zzqx' || item_id else text end as query from benchmark"""


@query(
    "overlap_search",
    f"""with {index_sql(ODD_QUERIES)} select query_id, doc_id, round(score, 6) as score, rank from (
      select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (
        select q.query_id, doc.doc_id, coalesce(overlap, 0.0) as score
        from q cross join doc left join pair on pair.query_id = q.query_id and pair.doc_id = doc.doc_id))
    where rank <= 5""",
)
def overlap_search(v: Views):
    odd = F.when(
        F.col("item_id") % 4 == 0, F.concat(F.lit("zzqx"), F.col("item_id").cast("string"))
    ).otherwise(F.col("text"))
    asked = v.benchmark.select(F.col("item_id").alias("query_id"), odd.alias("query"))
    return _rounded(retrieval.overlap_search(asked, retrieval.build_index(v.documents)))


RRF_QUERY = f"with {index_sql()}, {RRF_SQL} select query_id, doc_id, round(score, 6) as score, rank from hits where rank <= 5"


@query("rrf_search", RRF_QUERY)
def rrf_search(v: Views):
    return _rounded(retrieval.rrf_search(_queries(v), retrieval.build_index(v.documents)))


@query("rrf_search_split", RRF_QUERY)
def rrf_search_split(v: Views):
    """From a written index."""
    return _rounded(retrieval.rrf_search(_queries(v), _stored(v)))


@query(
    "query_expand",
    """with base as (select ticket_id, description as query from {tickets}),
    expanded as (
      select ticket_id, 0 as pos, query from base
      union all select ticket_id, 1, query || ' CUDA Out of Memory memory leak heap allocation' from base
        where lower(query) like '%oom%' or lower(query) like '%memory%'
      union all select ticket_id, 2, query || ' p95 p99 response time CPU throttling bottleneck' from base
        where lower(query) like '%latency%' or lower(query) like '%slow%')
    select ticket_id, query, cast(row_number() over (partition by ticket_id order by pos) - 1 as int) as variant from expanded""",
)
def query_expand(v: Views):
    return retrieval.expand_queries(v.tickets.select("ticket_id", F.col("description").alias("query")))


@query(
    "chunk_documents",
    r"""with w as (select doc_id, source, regexp_extract_all(text, '\S+\s*') as words from documents),
    s as (select *, len(words) as n, unnest(range(0, 1 + cast(ceil(greatest(0, len(words) - 400) / 350.0) as int))) as chunk_index
      from w where len(words) > 0),
    c as (select doc_id, source, cast(chunk_index as int) as chunk_index, words[chunk_index * 350 + 1 : chunk_index * 350 + 400] as part from s),
    t as (select *, rtrim(array_to_string(part, ''), ' ') as chunk_text from c)
    select doc_id, chunk_index, len(part) as token_count, chunk_text,
      substr(sha256(source || ':' || chunk_index || ':' || substr(chunk_text, 1, 30)), 1, 16) as chunk_id from t""",
)
def chunk_documents(v: Views):
    return retrieval.chunk_documents(v.documents).drop("source")


@query("chunk_recursive")
def chunk_recursive(v: Views):
    """Recursion over separators; a test compares it with a plain version."""
    return retrieval.recursive_chunks(v.documents).drop("source")


@query(
    "kb_answer",
    f"""with {index_sql(ODD_QUERIES)}, {RRF_SQL}
    select q.query_id, coalesce(answer, 'No matching runbook found.') as answer from q left join (
      select query_id, string_agg('[' || doc_id || '] ' || text, chr(10) || '---' || chr(10) order by rank) as answer
      from hits join documents using (doc_id) where rank <= 2 group by query_id) using (query_id)""",
)
def kb_answer(v: Views):
    odd = F.when(
        F.col("item_id") % 4 == 0, F.concat(F.lit("zzqx"), F.col("item_id").cast("string"))
    ).otherwise(F.col("text"))
    asked = v.benchmark.select(F.col("item_id").alias("query_id"), odd.alias("query"))
    return retrieval.kb_answers(asked, v.documents, retrieval.build_index(v.documents))
