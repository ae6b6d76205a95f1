"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest
import xxhash

import corpus_pipeline
from opsloom.llm import near_copies
from opsloom.llm.components import star_forest
from opsloom.llm.simhash import SEED
from tests.llm.conftest import HARD, SMALL


def brute_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows):
    """Smallest doc_id, nulls last, of each component of the rows that are similar."""
    sets = [brute_shingles(r[1]) for r in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                part[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min(ids, key=lambda d: (d is None, d or 0)) for ids in groups.values()), key=str)


def near_rows():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    line = "this line stands in nearly all of the texts here".split()
    rows = list(HARD)
    for family in range(12):
        base = [draw.choice(words) for _ in range(draw.choice((4, 6, 9, 30, 120)))]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(5)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((100 + len(rows), " ".join(copy + line * draw.randrange(2))))
    return rows


@pytest.mark.parametrize("paired", [1, 3, 32])
def test_near_copies_match_brute_force(documents, monkeypatch, paired):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    rows = near_rows()
    got = near_copies.kept_documents(documents(rows))
    assert got.columns == documents([]).columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_kept(rows)


def test_the_stage_takes_five_words_and_similarity(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SMALL).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id for r in got), key=str) == brute_kept(rows)


def test_near_copies_of_nothing(documents):
    assert near_copies.kept_documents(documents([])).count() == 0


def brute_print(text):
    hashes = [xxhash.xxh64_intdigest(x, SEED) for x in brute_shingles(text)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_links_texts_within_two_bits(documents, monkeypatch):
    rows = [(i, r[1]) for i, r in enumerate(near_rows())]
    texts = documents(rows).selectExpr("doc_id as key", "text").cache()
    linked = []
    plain = near_copies.print_pairs
    monkeypatch.setattr(near_copies, "print_pairs", lambda firsts: linked.append(plain(firsts)) or linked[0])
    near_copies.near_edges(texts).collect()
    prints = [brute_print(t) for _, t in rows]
    want = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    assert len(set(want)) < len(rows)
    roots = {r.node: r.root for r in star_forest(linked[0]).collect()}
    assert [roots.get(i, i) for i in range(len(rows))] == want


@pytest.mark.parametrize("edits", [5, 12])
def test_copies_with_different_edits_make_few_comparisons(documents, monkeypatch, edits):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 240):
        copy = list(base)
        for _ in range(draw.randrange(edits)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    compared = []
    plain = near_copies.verified
    monkeypatch.setattr(
        near_copies, "verified", lambda pairs, texts: compared.append(pairs.count()) or plain(pairs, texts)
    )
    got = near_copies.kept_documents(documents(rows))
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_kept(rows)
    assert sum(compared) < 3 * len(rows)


def edited_copies(n, most, kept_base):
    """Texts that stand near one base with up to ``most`` edits of 150 words; the base itself only if asked for."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(150)]
    rows = [(0, " ".join(base))] if kept_base else []
    for i in range(1, n):
        copy = list(base)
        for _ in range(draw.randrange(1, most + 1)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    return rows


def test_copies_without_their_base_make_few_comparisons(documents, monkeypatch):
    # Each pivot has edits of its own, so all others share differences from it; many are no copies of each other.
    rows = edited_copies(500, 6, kept_base=False)
    compared = []
    plain = near_copies.verified
    monkeypatch.setattr(
        near_copies, "verified", lambda pairs, texts: compared.append(pairs.count()) or plain(pairs, texts)
    )
    got = near_copies.kept_documents(documents(rows))
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_kept(rows)
    assert sum(compared) < 2 * len(rows)


def test_sketches_differ_in_no_more_cells_than_texts_in_shingles(documents):
    rows = edited_copies(40, 12, kept_base=True) + list(HARD)
    texts = [near_copies.shingles(t) for _, t in rows]
    cells = [sum(int(x) % 2**64 << 64 * i for i, x in enumerate(near_copies.text_sketch(t))) for t in texts]
    for a, x in zip(texts, cells, strict=True):
        for b, y in zip(texts, cells, strict=True):
            assert (x ^ y).bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))
    asked = documents(rows).sparkSession.createDataFrame(
        [([int(v) for v in near_copies.text_sketch(t)],) for t in texts], "a_sketch array<long>"
    ).selectExpr("a_sketch", "transform(a_sketch, x -> 0L) as b_sketch")
    got = [r.n for r in asked.select(near_copies.sketch_distance().alias("n")).collect()]
    assert got == [c.bit_count() for c in cells]


def test_kept_documents_shuffles_no_text_to_drop_rows(spark, documents):
    rows = [(i, r[1]) for i, r in enumerate(near_rows())]
    kept = near_copies.kept_documents(documents(rows))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and kept.columns == documents(rows).columns
    assert 0 < kept.count() < len(rows)
