"""Index blocks and rank fusion, radix selection, doubled paths, recursive chunks, nested numbers."""

import math
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsloom.operators import retrieval, topology
from opsloom.plans import quantiles
from opsloom.sources.logs import sanitize_nonfinite


@pytest.fixture(scope="module")
def corpus(spark):
    """Zipf-like words; every query's rare words stand in a few documents only."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(1, 60)))) for i in range(600)]
    queries = []
    for q in range(12):
        own = [f"rare{q}{x}" for x in "abc"]
        queries.append((q, " ".join(own + draw.choices(words, weights, k=6))))
        for doc in draw.sample(range(600), 7):
            docs[doc] = (doc, docs[doc][1] + " " + " ".join(own[: draw.randrange(1, 4)]))
    docs += [(600, ""), (601, None), (602, "w0")]
    queries += [(12, "unknown"), (13, ""), (14, "w0"), (15, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(queries, "query_id long, query string"),
    )


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    retrieval.write_index(retrieval.build_index(corpus[0]), path, slice_docs=16)
    return retrieval.read_index(spark, path)


def test_block_max_search_equals_the_full_one(corpus, stored):
    docs, queries = corpus
    want = rows(retrieval.bm25_search(queries, retrieval.build_index(docs), 5), "query_id", "rank")
    assert rows(retrieval.bm25_search(queries, stored, 5), "query_id", "rank") == want
    assert {r["query_id"] for r in want} == {*range(12), 14}


def test_index_slices_are_put_together_by_one_task_each(stored):
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    blocks = stored.blocks.select("slice", "bucket", part.alias("task"))
    tasks = blocks.groupBy("slice").agg(F.count_distinct("task").alias("tasks"), F.count_distinct("bucket").alias("n"))
    assert {r.tasks for r in tasks.collect()} == {1} and tasks.where("n > 16").count()
    assert stored.blocks.groupBy("term", "slice").count().where("count > 1").isEmpty()


def test_block_max_search_skips_slices_and_buckets(corpus, stored):
    queries = corpus[1].where("query_id < 12")
    asked, blocks = retrieval.asked_blocks(queries, stored)
    open_ = retrieval.open_slices(asked, blocks, stored.mean_len, 2)
    every = blocks.join(asked, "term").select("query_id", "slice").distinct().count()
    assert 0 < open_.count() < 0.5 * every
    one = corpus[1].where("query_id = 14")
    found, _ = stored.asked(retrieval.query_terms(one).select("term"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert {r.bucket for r in found.select("bucket").collect()} == {found.select(retrieval.term_bucket(F.lit("w0"))).first()[0]}


def test_tokens_are_cut_once(corpus):
    docs, queries = corpus
    plan = retrieval.match_scores(queries, retrieval.build_index(docs))._jdf.queryExecution().executedPlan().toString()
    # What is left are the tokens of the queries; the corpus was written as postings.
    assert "text#" not in plan


def test_pairs_are_added_up_where_they_arise(corpus):
    """Query-document pairs outnumber all else: only postings are shuffled, by document."""
    docs, queries = corpus
    plan = retrieval.match_scores(queries, retrieval.build_index(docs))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)


def test_stored_search_adds_pairs_up_by_slice(corpus, stored):
    """A search in a stored index shuffles blocks by slice, and no query-document pairs."""
    _, queries = corpus
    plan = retrieval.bm25_search(queries, stored, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(slice#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id|hashpartitioning\(term#\d+, slice", plan)


def test_texts_are_counted_in_tasks_of_bounded_size(views, monkeypatch):
    queries = views.benchmark.selectExpr("item_id as query_id", "text as query")
    want = rows(retrieval.bm25_search(queries, retrieval.build_index(views.documents)), "query_id", "rank")
    monkeypatch.setattr(retrieval, "COUNT_BYTES", 4096)
    monkeypatch.setattr(retrieval, "MEETINGS", 500)
    index = retrieval.build_index(views.documents)
    assert index.words.rdd.getNumPartitions() > 8
    assert rows(retrieval.bm25_search(queries, index), "query_id", "rank") == want


def brute_fusion(spark, scored, k):
    out = []
    pairs = defaultdict(list)
    for r in scored.collect():
        pairs[r["query_id"]].append(r)
    for query, found in pairs.items():
        ranks = defaultdict(float)
        for by in ("bm25", "overlap"):
            for i, r in enumerate(sorted(found, key=lambda r: (-r[by], r["doc_id"]))):
                ranks[r["doc_id"]] += 1.0 / (60 + i + 1)
        best = sorted(((d, round(s, 12)) for d, s in ranks.items()), key=lambda x: (-x[1], x[0]))[:k]
        out += [(query, d, round(s, 9), i + 1) for i, (d, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_fusion_without_a_full_sort(spark, corpus, stored, k):
    docs, queries = corpus
    want = brute_fusion(spark, retrieval.match_scores(queries, retrieval.build_index(docs)), k)
    for index in (retrieval.build_index(docs), stored):
        got = retrieval.rrf_search(queries, index, k).collect()
        assert sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in got) == want


DOUBLES = [
    0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1.0, 0),
    math.nextafter(1.0, 2), -1.0, 2.0**52, 2.0**53 + 2, 1e308, 1.7976931348623157e308, -1.7976931348623157e308,
    float("inf"), float("-inf"), float("nan"), 0.1, 1 / 3, math.nextafter(8.0, 0), 2.0**-1022 * 3,
]


def test_integers_of_doubles_keep_order_and_value(spark):
    draw = random.Random(8)
    values = DOUBLES + [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(3000)] + [2.0**e for e in range(-1070, 1024, 7)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").withColumn("o", quantiles.ordered_integer(F.col("v")))
    got = frame.withColumn("back", quantiles.integer_value(F.col("o"))).collect()
    assert all(r.back == r.v or (math.isnan(r.v) and math.isnan(r.back)) for r in got)
    known = sorted((r for r in got if not math.isnan(r.v)), key=lambda r: r.v)
    assert all((a.o < b.o) == (a.v < b.v) for a, b in zip(known, known[1:]))
    assert max(r.o for r in known) < min(r.o for r in got if math.isnan(r.v))


def test_radix_selection_is_exact_with_one_hot_key(spark):
    draw = np.random.default_rng(2)
    data = {"hot": np.round(draw.lognormal(3, 2, 4000), 2).tolist() + [7.25] * 2000, "one": [3.5], None: [1.0, -2.0, -2.0], "same": [4.0] * 9}
    data["tiny"] = [5e-324, -1e308, 1e-310, 0.0, 1e-311]
    frame = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("none", None)], "k string, v double")
    probs = (0.0, 0.5, 0.95, 0.99, 1.0)
    names = [f"q{i}" for i in range(len(probs))]
    got = {r["k"]: [r[n] for n in names] for r in quantiles.exact_quantiles(frame, ["k"], "v", probs, names, split=True).collect()}
    assert set(got) == set(data)
    for key, values in data.items():
        assert got[key] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=0)


def test_a_round_holds_a_bounded_number_of_cells(spark):
    """However many rows a key has, a round counts at most 65,536 cells for each wanted prefix."""
    frame = spark.range(200_000).select(F.lit("hot").alias("k"), quantiles.ordered_integer(F.rand(1) * 1000).alias("_bits"))
    cells = quantiles.cell_counts(frame, ["k"], quantiles.SHIFTS[0])
    assert cells.count() <= 65_536 and cells.agg(F.sum("_rows")).first()[0] == 200_000


def brute_pairs(edges):
    ahead = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            ahead[a].add(b)
    found = set()
    for root in list(ahead):
        stack, seen = list(ahead[root]), set()
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                stack += ahead.get(node, ())
        found |= {(root, node) for node in seen if node != root}
    return found


def graphs():
    draw = random.Random(6)
    tree = [(i, draw.randrange(i)) for i in range(1, 60)]
    rho = [(i, i + 1) for i in range(12)] + [(12, 7), (20, 3), (21, 20), (30, 31), (31, 30), (40, 40), (None, 1), (2, None)]
    return {
        "tree": tree,
        "reversed tree": [(b, a) for a, b in tree],
        "cycle with tails": rho,
        "tails out of a cycle": [(b, a) for a, b in rho if a is not None and b is not None],
        "general": [(draw.randrange(25), draw.randrange(25)) for _ in range(45)] * 2,
        "nothing": [],
    }


@pytest.mark.parametrize("name", list(graphs()))
def test_closure_matches_brute_force(spark, name):
    edges = graphs()[name]
    frame = spark.createDataFrame(edges, "src long, dst long")
    want = brute_pairs(edges)
    got = [tuple(r) for r in topology.closure(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = defaultdict(int)
    for _, node in want:
        counts[node] += 1
    assert {r.node: r.dependents for r in topology.dependent_counts(frame).collect()} == counts
    roots = spark.createDataFrame([(r,) for r in (0, 7, 30, 99)], "service long")
    limited = [tuple(r) for r in topology.blast_radius(frame, roots).collect()]
    assert sorted(limited) == sorted((b, a) for a, b in want if b in (0, 7, 30, 99))


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    """A chain of 10,000 in about 14 rounds: from one root either way, and counted without pairs."""
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rounds = []
    real = topology.durable
    monkeypatch.setattr(topology, "durable", lambda df: rounds.append(1) or real(df))
    root = spark.createDataFrame([(0,)], "s long")
    assert topology.dependencies(chain, root).count() == 10_000
    assert topology.blast_radius(chain, spark.createDataFrame([(10_000,)], "s long")).count() == 10_000
    assert len(rounds) <= 2 * (2 * 15 + 4)
    rounds.clear()
    counts = topology.dependent_counts(chain)
    assert counts.agg(F.sum("dependents"), F.max("dependents")).first() == (10_000 * 10_001 // 2, 10_000)
    assert len(rounds) <= 3 * 15 + 4


def brute_chunks(text, size, overlap, separators):
    """The same definition by plain lists, one text at a time."""
    length = lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t))

    def cut(piece, separator):
        if not separator:
            return list(piece)
        first, *others = piece.split(separator)
        return [p for p in [first, *[separator + o for o in others]] if p]

    def merged(run):
        found, start = [], 0
        for i, piece in enumerate(run):
            total = sum(map(length, run[start:i]))
            if total + length(piece) > size:
                if i > start:
                    found.append("".join(run[start:i]))
                while start < i:
                    total = sum(map(length, run[start:i]))
                    if total <= overlap and (total + length(piece) <= size or total == 0):
                        break
                    start += 1
        return [*found, "".join(run[start:])]

    def chunks(piece, at):
        while at < len(separators) - 1 and separators[at] not in piece:
            at += 1
        found, run = [], []
        for part in cut(piece, separators[at]):
            if length(part) < size:
                run.append(part)
                continue
            if run:
                found += merged(run)
                run = []
            found += chunks(part, at + 1) if at < len(separators) - 1 else [part]
        return found + (merged(run) if run else [])

    return [c.strip() for c in chunks(text, 0) if c.strip()] if text else []


@pytest.mark.parametrize("size, overlap", [(6, 2), (20, 5), (3, 0), (400, 50)])
def test_recursive_chunks_match_brute_force(spark, size, overlap):
    draw = random.Random(size)
    texts = [None, "", "  ", "one", "a b c d e f g h. i j. k\n\nl", "x" * 50, "\n\n\n", "No. 1. No. 2. " * 9]
    for _ in range(25):
        words = [draw.choice(["alpha", "be", "c.", "d", "é"]) for _ in range(draw.randrange(1, 120))]
        texts.append("".join(w + draw.choice([" ", " ", " ", ". ", "\n", "\n\n", "  "]) for w in words))
    frame = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = defaultdict(list)
    for r in rows(retrieval.recursive_chunks(frame, size, overlap), "doc_id", "chunk_index"):
        assert r["chunk_index"] == len(got[r["doc_id"]]) and len(r["chunk_id"]) == 16
        got[r["doc_id"]].append(r["chunk_text"])
    want = {i: c for i, t in enumerate(texts) if (c := brute_chunks(t, size, overlap, retrieval.SEPARATORS))}
    assert got == want
    by_letters = retrieval.recursive_chunks(frame.where("doc_id = 5"), 20, 4, length=F.char_length)
    assert [len(r["chunk_text"]) for r in rows(by_letters, "chunk_index")] == [20, 20, 18]


def test_recursive_chunks_stay_within_their_size(spark):
    text = "Enterprise AI operations platform requires hybrid vector search. " * 10
    frame = spark.createDataFrame([(1, text, "test_doc")], "doc_id int, text string, source string")
    got = rows(retrieval.recursive_chunks(frame, 50, 10), "chunk_index")
    assert len(got) > 1 and all(r["token_count"] <= 50 for r in got)


def test_nested_numbers_are_sanitised(spark):
    inf, nan = float("inf"), float("nan")
    schema = "id int, body struct<a: double, name: string, xs: array<struct<v: float, n: int>>, m: map<string, array<double>>, e: struct<z: double>>"
    data = [
        (1, (inf, "n", [(nan, 1), (2.5, 2), None], {"k": [1.0, -inf, None], "l": None}, None)),
        (2, None),
        (3, (1.0, None, None, None, (nan,))),
    ]
    got = rows(sanitize_nonfinite(spark.createDataFrame(data, schema), ["body"]), "id")
    first, _, third = got
    assert first["body"] == {
        "a": None, "name": "n", "xs": [{"v": None, "n": 1}, {"v": 2.5, "n": 2}, None],
        "m": {"k": [1.0, None, None], "l": None}, "e": None,
    }
    assert first["body_text"] == {
        "a": "inf", "name": None, "xs": [{"v": "nan", "n": None}, {"v": None, "n": None}, None],
        "m": {"k": [None, "-inf", None], "l": None}, "e": None,
    }
    assert got[1]["body"] is None and got[1]["body_text"] is None
    assert third["body"]["e"] == {"z": None} and third["body_text"]["e"] == {"z": "nan"}
