"""Quality, toxicity and the pipeline: held-out accuracy, disguises, and stages by brute force."""

import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from opsloom.llm import mixing, quality, toxicity
from tests.llm.conftest import HARD, SMALL
from tests.llm.test_near_copies import brute_kept

LARGER = "/root/testdata/sf0.01"


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def accuracy(spark, run, name, label, folds, fold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = run(name, LARGER).collect()
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    for r in got:
        assert r.held_out == held_out(r.doc_id, folds, fold)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    tested = [r for r in got if r.held_out and r.doc_id in labels]
    return sum(r.predicted == labels[r.doc_id] for r in tested) / len(tested)


def test_quality_on_held_out_rows(spark, run):
    assert accuracy(spark, run, "op9_quality", "quality", 5, 0) > 0.95


def test_toxicity_on_held_out_rows(spark, run):
    assert accuracy(spark, run, "op8_toxicity", "toxic", 4, 2) > 0.9


def test_non_negative_risk_separates():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(1, 0.5, (400, 3)), draw.normal(-1, 0.5, (100, 3))
    model = quality.fit_positive_unlabelled(good[:200], np.vstack([good[200:], bad[:50]]), 0.8)
    # The non-negative bound stops pushing the bad ones down early, so the order is what holds;
    # the cut at 0.3 is held to account on labelled rows above.
    assert model.scores(good).min() > model.scores(bad).max()
    assert model.scores(good).min() > quality.THRESHOLD
    assert quality.fit_positive_unlabelled(good[:0], good, 0.5).scores(good).tolist() == [0.5] * 400


def label_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_models_without_usable_labels(spark, documents):
    for rows in ([], [(None, 1, 1), (3, None, None)]):
        labels = label_frame(spark, rows)
        assert {r.score for r in quality.scored(documents(HARD), labels).collect()} == {0.5}
        assert all(r.predicted == 0 for r in toxicity.scored(documents(HARD), labels).collect())
        assert quality.scored(documents([]), labels).count() == 0
        assert toxicity.scored(documents([]), labels).count() == 0


def test_disguised_insults(spark, documents):
    rows = [(1, "you 1d10t"), (2, "уоu іdіоt"), (3, "an idiot proof plan"), (4, "STUPID!"), (5, "st@tion"), (6, "c1own"), (7, None)]
    got = {r.doc_id: r.predicted for r in toxicity.scored(documents(rows), label_frame(spark, [])).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0}


def plain_strength(lexicon, text):
    """The same sum by looking for every entry and exception at every place."""
    body, hits, safe = toxicity.folded(text), {}, set()
    places = lambda entry: [i for i in range(len(body)) if body.startswith(entry, i)]
    for phrase in map(toxicity.folded, toxicity.EXCEPTIONS):
        for at in places(phrase):
            safe |= set(range(at, at + len(phrase) - 1))
    for entry, weight in lexicon.items():
        for at in places(entry):
            hits[at] = max(hits.get(at, 0.0), weight)
    total = sum(w for at, w in hits.items() if at not in safe and w > 0)
    return total / np.sqrt(1 + np.log1p(body.count(" ") / 500))


def test_strength_matches_a_plain_search():
    draw = np.random.default_rng(12)
    lexicon = toxicity.seed_lexicon() | {" the ": 0.5, " the": 1.5, " clo": 2.5, " scum ": 0.25, " proo": -1.0}
    automaton = toxicity.Model(lexicon).automaton()
    words = ["idiot", "1d10t", "proof", "scum", "pond", "the", "then", "clown", "fish", "cl0wn", "class", "a", "é", "--", "tr@sh", "can"]
    for _ in range(300):
        text = " ".join(draw.choice(words, draw.integers(0, 40)))
        assert np.isclose(toxicity.strength(automaton, text), plain_strength(lexicon, text), rtol=1e-12)


def test_the_fit_follows_the_gradient_of_the_non_negative_risk(monkeypatch):
    """Step by step against numerical slopes of the risk, in both of its branches."""
    draw = np.random.default_rng(6)
    good, web, prior = draw.normal(1, 1, (30, 2)), draw.normal(0, 1, (40, 2)), 0.6
    monkeypatch.setattr(quality, "STEPS", 40)
    model = quality.fit_positive_unlabelled(good, web, prior)
    rows = np.vstack([good, web])
    shape = quality.Model(rows.mean(axis=0), rows.std(axis=0) + 1e-6)
    a, b = shape.inputs(good), shape.inputs(web)
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    weights, mean, square, branches = np.zeros(a.shape[1]), 0.0, 0.0, set()
    for step in range(1, 41):
        as_bad = lambda w: loss(-b @ w) - prior * loss(-a @ w)
        risk = lambda w: prior * loss(a @ w) + as_bad(w)
        goal = risk if as_bad(weights) >= 0 else lambda w: -as_bad(w)
        branches.add(as_bad(weights) >= 0)
        slope = np.array([(goal(weights + e) - goal(weights - e)) / 2e-6 for e in np.eye(len(weights)) * 1e-6])
        slope = slope + quality.DECAY * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights = weights - quality.RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(model.weights, weights, atol=1e-3)


def test_entries_are_counted_once_per_text():
    assert " idiot " not in toxicity.entries_of("idiots")
    assert toxicity.folded(" Lowei-8x\n") == toxicity.folded("lowei x")


def test_pipeline(spark, documents):
    """Each stage on what the one before kept, against plain versions of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SMALL)
    scores = quality.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in scores.where("predicted = 1").collect()}
    rows = good.collect()
    assert {r.doc_id for r in rows} == want and good.columns == docs.columns
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    first = {}
    for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
        first.setdefault(strip(r.text), r)
    unique = stages["exact_dedup"](spark, good, SMALL).collect()
    assert sorted(unique) == sorted(first.values())
    frame = spark.createDataFrame(unique, docs.schema)
    near = stages["simhash"](spark, frame, SMALL).collect()
    assert sorted((r.doc_id for r in near), key=str) == brute_kept([(r.doc_id, r.text) for r in unique])
    frame = spark.createDataFrame(near, docs.schema)
    mix = stages["mixing"](spark, frame, SMALL).collect()
    taken = {r.doc_id: r for r in mixing.mixed(frame).collect()}
    assert Counter(r.doc_id for r in mix) == Counter({d: n for d, r in taken.items() if (n := int(r.taken / r["size"] + 0.5))})
    assert len(corpus_pipeline.run(spark, SMALL).collect()) == len(mix)


def test_entry_lists_the_corpus_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_a_repeated_id_reaches_the_driver_once(spark, documents):
    docs = documents([(1, "some words here")] * 50 + [(1, "OTHER WORDS!!")] * 50 + [(2, None), (3, "x")])
    ids = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    found = quality.measured(docs, ids)
    assert len(found) == 2
    assert sorted(map(tuple, found)) == sorted(map(tuple, quality.measured(docs.repartition(5), ids)))
    rows = docs.selectExpr("doc_id", "text", "doc_id = 1 as toxic")
    pairs = toxicity.calibrated(toxicity.seed_lexicon(), rows)
    assert pairs.slope > 0
